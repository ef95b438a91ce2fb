"""Sharding by sampled splitters.

Records are ordered by (hash of the text, id), so equal texts are neighbours. A sample in which a record's chance is its
size gives quantiles as splitters of many small ranges; a range that turns out overfull is sampled again, more densely,
and subdivided, so a group of equal texts that holds a third of all bytes is cut by id. Shards are runs of ranges: the
bytes before a range are known exactly, and within a range the order decides, so that shards differ by a record or so.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

LAW = "bytes"
#: Least ranges of a shard, bytes that a range should hold beyond these, most ranges in all; sampled records for each range.
RANGES, RANGE_BYTES, MOST, SAMPLE = 32, 64 << 20, 16_384, 40
LOWEST = -(2**63)


def place(h: np.ndarray, i: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """How many cuts are at or before each (h, i)."""
    edges = np.array([c[0] for c in cuts], np.int64)
    lo, hi = np.searchsorted(edges, h, "left"), np.searchsorted(edges, h, "right")
    for k in np.flatnonzero(lo < hi):
        lo[k] = bisect_right(cuts, (int(h[k]), int(i[k])), int(lo[k]), int(hi[k]))
    return lo


def cuts_of(sample: list[tuple[int, int, float]], step: float) -> list[tuple[int, int]]:
    """Quantiles ``step`` bytes apart. The first cut in a group of equal texts comes before all of it."""
    out, at = [], 0.0
    for h, i, weight in sorted(sample):
        if at + weight >= step:
            cut = (h, i) if out and out[-1][0] == h else (h, LOWEST)
            if not out or cut > out[-1]:
                out.append(cut)
                at = 0.0
                continue
        at += weight
    return out


def sharded(docs: DataFrame, shards: int = 8, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; size is the text's UTF-8 bytes plus one.

    The law is that shards have nearly equal bytes: they differ by about the largest record. Equal texts are in one shard
    unless a cut must fall among them. A null text has size 1 and the checksum of no bytes; a null id sorts first; repeated
    rows are records of their own; an empty table gives an empty result. With ``keep_columns`` the columns of ``docs``
    come first, under their names (the text among them), and only shard and slot are added; own columns of these two names
    give way.
    """
    names = docs.columns
    docs = docs.toDF(*(f"__c{i}" for i in range(len(names))))
    id_col, text_col = (f"__c{names.index(c)}" for c in (id_col, text_col))
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = [F.col(f"`{id_col}`").cast("long").alias("__id"), (F.octet_length(text) + 1).cast("long").alias("__size"), F.crc32(text).alias("__crc"), F.xxhash64(text).alias("__h")]
    rows = scratch.save(docs.select(*keys), "keys")
    total = rows.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    step = max(1.0, total / (shards * min(max(RANGES, total // (shards * RANGE_BYTES)), max(RANGES, MOST // shards))))
    chance = lambda salt: F.pmod(F.xxhash64("__h", "__id", F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    order_id = F.coalesce("__id", F.lit(LOWEST))
    cuts: list[tuple[int, int]] = []

    def ranged(df: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(list(cuts))

        @F.pandas_udf("int")
        def number(h: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(place(h.to_numpy(np.int64), i.to_numpy(np.int64), held.value).astype(np.int32))

        return df.withColumn("__range", number("__h", order_id))

    dense = SAMPLE / step
    part = rows
    for turn in range(rounds):
        sample = part.where(chance(seed + turn) < F.col("__size") * dense).select("__h", order_id.alias("i"), F.greatest(F.col("__size").cast("double"), F.lit(1 / dense)).alias("w"))
        sample = [tuple(r) for r in sample.collect()]  # about SAMPLE for each range, by the chance's sum
        known = set(cuts)
        cuts = sorted(known | set(cuts_of(sample, step)))
        sums = {r["__range"]: r["b"] for r in ranged(rows).groupBy("__range").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).where("n > 1").select("__range", "b").collect()}
        over = [k for k, b in sums.items() if b > 2 * step]
        if not over or set(cuts) == known and turn:
            break
        part, dense = ranged(rows).where(F.col("__range").isin(over)).drop("__range"), dense * 2
    base = ranged(docs.select("*", *keys) if keep_columns else rows)
    key_rows = ranged(rows)
    per = sorted(tuple(r) for r in key_rows.groupBy("__range").agg(F.sum("__size")).collect())
    before = np.concatenate([[0], np.cumsum([b for _, b in per])]).astype(np.int64)
    starts = spark.createDataFrame([(r, int(b)) for (r, _), b in zip(per, before, strict=False)], "__range int, __before long")
    w = Window.partitionBy("__range").orderBy("__h", order_id, "__crc")

    def shard_of(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(starts), "__range")
        up_to = F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0))
        middle = F.col("__before") + up_to - F.col("__size") / 2
        return df.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(1, total))).cast("int")))

    count = sorted(tuple(r) for r in shard_of(key_rows).groupBy("shard", "__range").agg(F.count("*")).collect())
    first, at, last = [], 0, None
    for s, r, n in count:
        at = 0 if s != last else at
        first.append((s, r, at))
        at, last = at + n, s
    first = spark.createDataFrame(first, "shard int, __range int, __first long")
    out = shard_of(base).withColumn("__n", F.row_number().over(Window.partitionBy("__range", "shard").orderBy("__h", order_id, "__crc")) - 1).join(F.broadcast(first), ["shard", "__range"])
    slot = (F.col("__first") + F.col("__n")).cast("long").alias("slot")
    if keep_columns:
        return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names) if c not in ("shard", "slot")], "shard", slot)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
