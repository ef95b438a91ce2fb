"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by hash. A source whose target is r times its size takes every block
floor(r) times and, for the rest, blocks of a permutation until the words suffice; of the last block, and of the few on
either side of it, only documents whose words come nearest to what is still open. The exact numbers of blocks that each source gives are split among the output shards by a tree: a
node divides its blocks between two halves of its shards by a multivariate hypergeometric draw, so a shard's mix is
that of a random deal of all blocks. A shard then draws the next blocks of each source's permutation, so no two shards
share a draw, and shuffles its rows by hash.

Only sums leave the executors: one row for each source goes to the driver, with its quotas for each shard on the way
back. Blocks of a source are at most ``BLOCKS``, whatever its size, and no task holds more than a block in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import Scratch

#: Most blocks of a source, and the documents that a block should hold at least.
BLOCKS, LEAST = 4096, 16
#: Blocks on either side of the one taken in part that are taken by documents, too, and documents that ``nearest`` weighs up.
BESIDE, WEIGHED = 3, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = 3.0) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    cap, out, open_ = most * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        share = (total - out[~open_].sum()) * weights / weights[open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap[over]
        open_ &= ~over
    return out


def split(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas [shard, source] that add up to ``blocks``; shards get equal numbers of blocks, give or take one."""
    if shards == 1:
        return blocks[None, :]
    left, rest = shards // 2, int(blocks.sum())
    take, given = int(round(rest * left / shards)), np.zeros_like(blocks)
    for k, n in enumerate(blocks):  # one hypergeometric draw after another is the multivariate one
        rest -= int(n)
        given[k] = rng.hypergeometric(n, rest, take) if take and n + rest else 0
        take -= int(given[k])
    return np.concatenate([split(given, left, rng), split(blocks - given, shards - left, rng)])


def nearest(sizes: np.ndarray, gap: float) -> np.ndarray:
    """Which of the documents to take, in their order, so that their sizes come near ``gap``: a mask.

    Those before the one that no longer fits are taken but for the last of them. These and the ones behind, 64 together,
    are chosen as the subset whose sum is nearest (from below, if two are): bit t of ``reach[i]`` says whether the
    first i of them have a subset of sum t. Beyond 2**20, sums are in units of gap / 2**20.
    """
    upto = np.cumsum(sizes)
    first = max(0, int(np.searchsorted(upto, gap, side="right")) - WEIGHED // 2)
    taken, open_ = np.arange(len(sizes)) < first, int(round(gap - (upto[first - 1] if first else 0)))
    unit = max(1, open_ >> 20)
    goal, weighed = open_ // unit, [max(1, int(s) // unit) for s in sizes[first : first + WEIGHED]]
    reach, below = [1], (1 << 2 * goal + 1) - 1  # what is over twice the goal is farther off than nothing
    for s in weighed:
        reach.append((reach[-1] | reach[-1] << s) & below if s <= 2 * goal else reach[-1])
    at, over = (reach[-1] & (1 << goal + 1) - 1).bit_length() - 1, reach[-1] >> goal + 1
    if over and (over & -over).bit_length() < goal - at:
        at = goal + (over & -over).bit_length()
    for i in reversed(range(len(weighed))):
        if not reach[i] >> at & 1:
            taken[first + i] = True
            at -= weighed[i]
    return taken


def sized(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with __size (words; null text: 0) and __key (the source's name, null apart)."""
    return docs.withColumn("__size", F.coalesce(F.expr(f"regexp_count(`{text_col}`, '{WORD.replace(chr(92), chr(92) * 2)}')"), F.lit(0)).cast("long")).withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null")))


def plan(rows: DataFrame, scratch: Scratch, shards: int, seed: int, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """For (id, __size, __key): one row for each source, and one for each block with its shards."""
    spark = rows.sparkSession
    got = [(r["__key"], r["n"], r["w"]) for r in rows.groupBy("__key").agg(F.count("*").alias("n"), F.sum("__size").alias("w")).collect()]
    got.sort(key=lambda r: (r[0] == "null", r[0].encode()))
    n, size = np.array([r[1] for r in got], np.int64), np.array([r[2] for r in got], float)
    weight = np.arange(len(got)) % 3 + 1.0
    target = targets(size, weight, share * size.sum(), most) if len(got) else size
    count = np.clip(n // LEAST, 1, BLOCKS)
    ratio = np.divide(target, size, out=np.zeros_like(size), where=size > 0)
    full = np.floor(ratio + 1e-12).astype(np.int64)
    rest = np.maximum(0.0, target - full * size)
    schema = "__key string, target double, source_size long, n_blocks int, full int, rest double"
    sources = spark.createDataFrame([(k, float(t), int(s), int(c), int(f), float(x)) for (k, _, _), t, s, c, f, x in zip(got, target, size, count, full, rest, strict=True)], schema)
    blocks = rows.join(F.broadcast(sources) if len(got) <= 100_000 else sources, "__key").groupBy("__key", "__block" if "__block" in rows.columns else F.pmod(F.xxhash64("id", F.lit(seed)), "n_blocks").cast("int").alias("__block")).agg(F.sum("__size").alias("words"))
    order = Window.partitionBy("__key").orderBy(F.xxhash64("__key", "__block", F.lit(seed + 1)), "__block")
    blocks = blocks.join(F.broadcast(sources) if len(got) <= 100_000 else sources, "__key").withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    # the part of a block's words that is taken once more: all, some or none
    blocks = scratch.save(blocks.withColumn("extra", F.least(F.col("words").cast("double"), F.greatest(F.lit(0.0), F.col("rest") - F.col("before")))), "blocks")
    drawn = {r["__key"]: r["m"] for r in blocks.groupBy("__key").agg(F.sum(F.col("full") + (F.col("extra") > 0).cast("int")).alias("m")).collect()}
    quota = split(np.array([drawn.get(k, 0) for k, _, _ in got], np.int64), shards, np.random.default_rng(seed)) if len(got) else np.zeros((shards, 0), np.int64)
    ends = spark.createDataFrame([(k, [int(x) for x in np.cumsum(quota[:, i])]) for i, (k, _, _) in enumerate(got)], T.StructType([T.StructField("__key", T.StringType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    made = blocks.join(F.broadcast(ends) if len(got) <= 100_000 else ends, "__key").withColumn("n_in", F.count("*").over(Window.partitionBy("__key")))
    # pass c of the permutation holds the draws c * n_in + place
    draws = F.expr("transform(sequence(0, full + int(extra > 0)), c -> size(filter(ends, e -> e <= c * n_in + place)))")
    made = made.withColumn("shards", F.when(F.col("full") + (F.col("extra") > 0).cast("int") > 0, F.slice(draws, F.lit(1), F.col("full") + (F.col("extra") > 0).cast("int"))).otherwise(F.array().cast("array<int>")))
    return sources, made.select("__key", "__block", "target", "source_size", "full", "words", "extra", "shards", "place")


def mixed(docs: DataFrame, shards: int = 16, seed: int = 17, share: float = 1.0, most: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source_size, target, copies, taken, shards).

    ``shards`` holds the output shard of each copy. Sources in order of their code points, null last, weigh 1, 2, 3 and so
    on again. A null text has size 0. Documents with a null id are placed by their text. Rows repeated under one id of a
    source are taken alike. Sources without words have target 0 and are not taken. An empty table gives an empty result. With
    ``keep_columns`` the columns of ``docs`` come first, under their names, also where these are names of the result.
    """
    names = docs.columns
    if keep_columns:
        id_col, source_col, text_col = (f"__c{names.index(c)}" for c in (id_col, source_col, text_col))
        docs = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    scratch = Scratch(docs.sparkSession, "mix")
    full = sized(docs, source_col, text_col).withColumn("__id", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(f"`{text_col}`")))
    rows = scratch.save(full.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("__id").alias("id"), "__size", "__key"), "rows")
    sources, blocks = plan(rows, scratch, shards, seed, share, most)
    blocks = scratch.save(blocks, "plan")
    hint = F.broadcast if blocks.count() <= 200_000 else (lambda df: df)
    counts = hint(sources.select("__key", "n_blocks"))
    # a source's block that is taken in part, and the few beside it: documents whose words come nearest to the open ones
    in_part = blocks.where("extra > 0 and extra < words").select("__key", F.col("place").alias("__from"), F.element_at("shards", -1).alias("shard"))
    near = blocks.select("__key", "__block", "place", "extra").join(hint(in_part), "__key").where(F.col("place").between(F.col("__from") - BESIDE, F.col("__from") + BESIDE))
    near = near.select("__key", "__block", (F.col("place") - F.col("__from")).alias("turn"), F.sum("extra").over(Window.partitionBy("__key")).alias("gap"), "shard")
    place = F.pmod(F.xxhash64("id", F.lit(seed)), "n_blocks").cast("int").alias("__block")
    part = rows.where("__size > 0").join(counts, "__key").select("id", "__size", "__key", place).join(hint(near), ["__key", "__block"])
    part = part.groupBy("__key", "id").agg(F.sum("__size").alias("__size"), *[F.first(c).alias(c) for c in ("turn", "gap", "shard")]).withColumn("order", F.xxhash64("id", F.lit(seed + 2)))

    def fill(docs):
        docs = docs.sort_values(["turn", "order", "id"])
        return docs.loc[nearest(docs["__size"].to_numpy(), float(docs["gap"].iloc[0])), ["__key", "id", "shard"]]

    own = part.groupBy("__key").applyInPandas(fill, "__key string, id long, shard int")
    own = scratch.save(own.select(F.col("__key").alias("__own_key"), F.col("id").alias("__own"), "shard"), "own")
    blocks = blocks.join(hint(near.select("__key", "__block", F.lit(True).alias("by_document"))), ["__key", "__block"], "left")
    base = (full.withColumn("id", F.col("__id")) if keep_columns else rows).join(counts, "__key").withColumn("__block", F.pmod(F.xxhash64("id", F.lit(seed)), "n_blocks").cast("int"))
    base = base.join(hint(blocks), ["__key", "__block"])
    base = base.join(F.broadcast(own) if own.count() <= 100_000 else own, (F.col("id") == F.col("__own")) & (F.col("__key") == F.col("__own_key")), "left")
    again = F.when(F.col("by_document"), F.col("__own").isNotNull()).otherwise(F.col("extra") > 0).cast("int")
    # documents from behind go where the block in part goes
    base = base.withColumn("shards", F.when(F.col("__own").isNotNull() & (F.col("extra") <= 0), F.concat("shards", F.array("shard"))).otherwise(F.col("shards")))
    base = base.withColumn("copies", F.when(F.col("source_size") > 0, F.col("full") + again).otherwise(0).cast("int"))
    out = [F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"), F.slice("shards", F.lit(1), F.col("copies")).alias("shards")]
    got = base.select(*(docs.columns if keep_columns else ["doc_id"]), *out)
    return got.toDF(*names, *got.columns[len(names) :]) if keep_columns else got


def mixture(docs: DataFrame, shards: int = 16, seed: int = 17, **how) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, dealt to ``shards`` and shuffled in each.

    A shard is as many tasks as its size asks for. Null texts, null ids, repeated rows, clashing names and an empty
    table are as in ``mixed``; a document without words is not taken.
    """
    own = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    names = {k: own[docs.columns.index(how.pop(k, v))] for k, v in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))}
    got = mixed(plain, shards, seed, keep_columns=True, **names, **how)
    got = got.select(*own, F.posexplode("shards").alias("__copy", "__shard"))
    return got.hint("rebalance", "__shard").sortWithinPartitions("__shard", F.xxhash64(names["id_col"], "__copy", F.lit(seed + 3))).select(*own).toDF(*docs.columns)
