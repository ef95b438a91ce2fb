import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def walk(spark):
    """A seeded walk of three series of different lengths, with gaps in close and volume."""
    import numpy as np
    import pandas as pd

    rng, rows = np.random.default_rng(42), []
    for k, n in (("a", 300), ("b", 120), ("c", 5)):
        px = 100 * np.cumprod(1 + rng.normal(0, 0.02, n))
        for i, day in enumerate(pd.bdate_range("2023-01-02", periods=n)):
            o, c = px[i] * (1 + rng.normal(0, 0.005)), px[i]
            rows.append((k, day.date(), o, max(o, c) * (1 + abs(rng.normal(0, 0.01))), min(o, c) * (1 - abs(rng.normal(0, 0.01))), c, float(rng.integers(1_000_000, 5_000_000))))
    pdf = pd.DataFrame(rows, columns=["SecuCode", "TradingDay", "OpenPrice", "HighPrice", "LowPrice", "ClosePrice", "TurnoverVolume"])
    return pdf, spark.createDataFrame(pdf)
