"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where it is unset, a folder of this process is used, and only with
a local master: on a cluster executors could not read it, so that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes a query's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: And the one that bounds an Arrow batch's bytes; rows here are whole texts.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
    return own_dir()


@functools.cache
def own_dir() -> str:
    """A folder of this process, which a local master's tasks share; the session's settings stay as they are."""
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder by Hadoop's file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def writing(spark: SparkSession):
    """Within: the shuffle files of a query go when it ends, as its rows have been written; Python gets small batches."""
    held = {CLEAN: "true", BATCH: "4m"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one run of an operator. ``save`` writes one and reads it back, which also cuts the lineage.

    A lazily returned result may still read its tables, so what is left goes when the process ends; ``free`` removes
    one earlier.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{name}-{self.n}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        with writing(self.spark):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    @contextlib.contextmanager
    def bucketed(self, df: DataFrame, key: str, buckets: float, then: Callable[[DataFrame], DataFrame]) -> Iterator[DataFrame]:
        """As ``save``, one file for each bucket of ``key``: joins on it then leave these rows where they are.

        ``then`` is applied to the rows dealt out by ``key``. The table leaves the catalog, and its files go, at the end
        of the block.
        """
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, int(buckets) + 1))
        name, path = "tidemark_" + uuid.uuid4().hex[:12], self.path("bucketed")
        try:
            with writing(self.spark):
                then(df.repartition(n, key)).write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
            yield self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)

    def free(self, *saved: DataFrame) -> None:
        for df in saved:
            delete(self.spark, df.scratch_path)

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session has ended before the process
            pass
