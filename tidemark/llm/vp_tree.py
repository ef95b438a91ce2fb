"""Approximate nearest neighbours by vantage-point trees, one for each shard.

A coarse vantage-point tree over a bounded sample cuts the space into regions; a region's vectors, dealt by hash into as
many shards as its number needs, make the shards. Each shard has a tree of its own: a node's vantage point splits its
vectors at the median distance, and the least and largest distance to it of either side are kept. By the triangle
inequality no vector of a side is nearer to the query than the gap between the query's distance and that interval. A
side is searched if ``factor`` times the gap is not above the best k-th distance so far: with factor one nothing that
counts is left out, and larger factors skip more.

A query first searches the shards of its own region, which gives it a bound; then the shards of the other regions whose
relaxed gap the bound does not exclude. Distances that are returned are exact, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Vectors of a shard and of a leaf of its tree; most vectors of the sample and regions of the coarse tree.
SHARD, LEAF, SAMPLE, REGIONS = 8192, 128, 20_000, 1024
#: Queries that search a shard together; where more do, its vectors go out once for each so many.
QUERIES = 20_000
#: One leaves nothing out. Larger ones skip more, and on data of mixed density too much: the figures are in the README.
FACTOR = 1.0


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances, by differences, so that equal vectors give the same everywhere."""
    out = np.empty((len(q), len(x)))
    step = max(1, 4_000_000 // max(1, x.size))
    for a in range(0, len(q), step):
        d = q[a : a + step, None, :] - x[None, :, :]
        out[a : a + step] = np.sqrt(np.einsum("qxd,qxd->qx", d, d))
    return out


class Node:
    __slots__ = ("high", "inner", "low", "outer", "rows", "vantage")

    def __init__(self, x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int):
        self.rows, self.inner = rows, None
        if len(rows) <= leaf:
            return
        # of a few candidates, the vantage point whose distances spread most
        tries, probe = rng.choice(rows, min(5, len(rows)), replace=False), rng.choice(rows, min(64, len(rows)), replace=False)
        self.vantage = x[tries[np.argmax(distances(x[tries], x[probe]).var(axis=1))]]
        d = distances(self.vantage[None], x[rows])[0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        if d[order[0]] == d[order[-1]]:  # equal distances: no split tells them apart
            return
        self.low, self.high = (d[order[0]], d[order[half - 1]]), (d[order[half]], d[order[-1]])
        self.inner, self.outer = Node(x, rows[order[:half]], rng, leaf), Node(x, rows[order[half:]], rng, leaf)
        self.rows = None


class Best:
    """The k nearest so far of each query, ties by id."""

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.d, self.i, self.bound = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), bound.copy()

    def add(self, who: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        k = self.d.shape[1]
        dd = np.concatenate([self.d[who], d], axis=1)
        ii = np.concatenate([self.i[who], np.broadcast_to(ids, d.shape)], axis=1)
        o = np.lexsort((ii, dd), axis=1)[:, :k]
        self.d[who], self.i[who] = np.take_along_axis(dd, o, 1), np.take_along_axis(ii, o, 1)
        self.bound[who] = np.minimum(self.bound[who], self.d[who, -1])


def search(node: Node, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, who: np.ndarray, best: Best, factor: float) -> None:
    """All queries ``who`` go down the tree together, nearer side first. ``own``: the id that a query must not find."""
    if node.inner is None:
        d = distances(q[who], x[node.rows])
        d[ids[node.rows][None, :] == own[who][:, None]] = np.inf
        best.add(who, d, ids[node.rows])
        return
    d = distances(node.vantage[None], q[who])[0]
    gaps = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in (node.low, node.high)]
    near = gaps[0] <= gaps[1]
    for side, first in ((node.inner, near), (node.outer, ~near)):
        if first.any():
            search(side, x, ids, q, own, who[first], best, factor)
    for side, gap, second in ((node.inner, gaps[0], ~near), (node.outer, gaps[1], near)):
        go = second & (factor * gap <= best.bound[who] * (1 + 1e-12))
        if go.any():
            search(side, x, ids, q, own, who[go], best, factor)


class Regions:
    """The coarse tree: its leaves are the regions. Bounds hold for all vectors, from the intervals that were measured."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.root = Node(sample, np.arange(len(sample)), np.random.default_rng(7), max(1, -(-len(sample) // regions)))
        self.leaves: list[list[tuple[int, int]]] = []
        self.vantages: list[np.ndarray] = []
        self.splits: list[float] = []
        self._walk(self.root, [])
        self.points = np.array(self.vantages) if self.vantages else np.zeros((0, sample.shape[1]))
        del self.root

    def _walk(self, node: Node, path: list[tuple[int, int]]) -> None:
        if node.inner is None:
            self.leaves.append(path)
            return
        at = len(self.vantages)
        self.vantages.append(node.vantage)
        self.splits.append((node.low[1] + node.high[0]) / 2)
        self._walk(node.inner, [*path, (at, 0)])
        self._walk(node.outer, [*path, (at, 1)])

    def of(self, x: np.ndarray) -> np.ndarray:
        """Each vector's region."""
        d = distances(x, self.points)
        out = np.zeros(len(x), np.int64)
        for leaf, path in enumerate(self.leaves):
            ok = np.ones(len(x), bool)
            for at, side in path:
                ok &= (d[:, at] > self.splits[at]) == bool(side)
            out[ok] = leaf
        return out

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """[query, region]: no vector of the region is nearer."""
        d = distances(q, self.points)
        out = np.zeros((len(q), len(self.leaves)))
        for leaf, path in enumerate(self.leaves):
            for at, side in path:
                out[:, leaf] = np.maximum(out[:, leaf], (self.splits[at] - d[:, at]) if side else (d[:, at] - self.splits[at]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, not zero, no null or non-finite component, of the commonest length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    return rows.where("v is not null and not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists(v, e -> e <> 0)")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors that each query finds, other than those of its own id.

    Vectors of a length other than the commonest take no part (on a tie, the shorter counts), nor do vectors null, zero
    or with a null or non-finite component; nor do rows with a null id. Of rows repeated under one id the least vector counts. Ties go to
    the smaller id. Fewer candidates give fewer rows, an empty table none. Other columns are not read.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vp")
    rows = usable(vectors, id_col, vector_col)
    sizes = sorted((-r["n"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect())
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    total, dim = -sizes[0][0], sizes[0][1]
    one = lambda df: df.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    rows = scratch.save(one(rows), "rows")
    asked = scratch.save(one(usable(queries, id_col, vector_col)), "asked")
    regions = int(min(REGIONS, max(1, total // (4 * shard))))
    order = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= (1 << 30) * min(1.0, 1.2 * SAMPLE / total)).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE)
    held = spark.sparkContext.broadcast(Regions(np.array([r["v"] for r in order.collect()] or [[0.0] * dim]), regions))

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.of(_matrix(b.column(1))).astype(np.int32))], names=["id", "v", "region"])

    placed = scratch.save(rows.mapInArrow(place, "id long, v array<double>, region int"), "placed")
    count = {r["region"]: r["n"] for r in placed.groupBy("region").agg(F.count("*").alias("n")).collect()}
    shards = {r: max(1, round(n / shard)) for r, n in count.items()}
    first = dict(zip(sorted(shards), np.cumsum([0, *(shards[r] for r in sorted(shards))]).tolist(), strict=False))
    plan = spark.createDataFrame([(r, shards[r], first[r]) for r in shards], "region int, parts int, first int")
    dealt = placed.join(F.broadcast(plan), "region").select((F.col("first") + F.pmod(F.xxhash64("id", F.lit(3)), "parts")).cast("int").alias("shard"), "id", "v")

    def ask(own: bool):
        def run(batches):
            tree = held.value
            for b in batches:
                q, ids, bound = _matrix(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                home, out = tree.of(q), ([], [])
                gaps = tree.gaps(q) * factor <= bound[:, None] * (1 + 1e-12)
                for r, n in shards.items():
                    for i in np.flatnonzero(home == r if own else gaps[:, r] & (home != r)):
                        out[0].extend([i] * n)
                        out[1].extend(range(first[r], first[r] + n))
                at = np.array(out[0], np.int64)
                for a in range(0, len(at), 4096):
                    part = pa.array(at[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(out[1][a : a + 4096], np.int32)), *(b.column(c).take(part) for c in range(3))], names=["shard", "id", "v", "bound"])

        return run

    def find(queries_in: pa.Table, vectors_in: pa.Table) -> pa.Table:
        if not queries_in.num_rows or not vectors_in.num_rows:
            return FOUND.empty_table()
        vectors_in = vectors_in.sort_by("id")
        x, ids = _matrix(vectors_in.column("v").combine_chunks()), vectors_in.column("id").to_numpy()
        q, own = _matrix(queries_in.column("v").combine_chunks()), queries_in.column("id").to_numpy()
        best = Best(len(q), k, queries_in.column("bound").to_numpy())
        search(Node(x, np.arange(len(x)), np.random.default_rng(1), LEAF), x, ids, q, own, np.arange(len(q)), best, factor)
        ok = np.isfinite(best.d)
        return pa.Table.from_arrays([pa.array(np.repeat(own, ok.sum(1))), pa.array(best.i[ok]), pa.array(best.d[ok])], schema=FOUND)

    def searched(bounds: DataFrame, own: bool) -> DataFrame:
        sent = scratch.save(bounds.select("id", "v", "bound").mapInArrow(ask(own), "shard int, id long, v array<double>, bound double"), "sent")
        load = sent.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        asked = sent.join(load, "shard").select("shard", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "v", "bound")
        full = dealt.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
        return asked.groupBy("shard", "part").cogroup(full.groupBy("shard", "part")).applyInArrow(find, "query_id long, vec_id long, score double")

    top = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    near = scratch.save(searched(asked.withColumn("bound", F.lit(float("inf"))), True), "near")
    if len(shards) > 1:
        bound = near.groupBy("query_id").agg(top.alias("t")).select(F.col("query_id").alias("id"), F.when(F.size("t") == k, F.element_at("t", -1)["score"]).alias("b"))
        more = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("b", F.lit(float("inf"))))
        near = near.union(searched(more, False))
    # a query has at most k rows of each shard that it searched
    return near.groupBy("query_id").agg(top.alias("t")).select("query_id", F.posexplode("t").alias("n", "t")).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
