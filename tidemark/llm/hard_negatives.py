"""Hard negatives by a nearest-neighbour join over a Voronoi partition.

Scores are inner products of whole numbers. Vectors get one component more, so that the largest product is the smallest
distance: with M the largest length, a candidate s becomes (s, sqrt(M^2 - |s|^2)), an anchor q becomes (q, 0), and their
squared distance is M^2 + |q|^2 - 2 q.s.

A bounded sample of the anchors are pivots; every vector belongs to the cell of its nearest pivot. Anchors of
neighbouring cells form groups, a crowded cell makes several. An anchor at distance r from its pivot looks for candidates
between two distances from itself; by the triangle inequality they are between the lower less r and the upper plus r from
the pivot. A cell of a group keeps the least and the largest of these bounds, and a candidate is copied to a group only
if its distance from the pivot of one of the group's cells lies within that cell's bounds.

The join runs twice, for positives (of the anchor's label) and then for negatives (of other labels, with scores in a band
below each positive's). Each time a group first meets the candidates of its own cells, whose best scores give the bounds
for the others. Candidates of a group are dealt into parts by hash; a part joins exactly, in blocks, and returns the best
few of each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import tidy

#: Most pivots; anchors of a group, at least and at most; candidates of a part, at least and at most.
PIVOTS, GROUP, PART = 256, (512, 65_536), (16_384, 1 << 20)
#: Anchors and candidates of a block whose scores are computed together.
BLOCK = (1024, 4096)
NONE, ALL = -(1 << 63), (1 << 63) - 1
FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor_id long, slot int, id long, score long"
OUT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row among those that are ok; ties to the earlier column."""
    n = score.shape[1]
    if n > k:
        held = np.where(ok, score, -np.inf if score.dtype.kind == "f" else NONE)
        ok = ok & (held >= np.partition(held, n - k, axis=1)[:, n - k, None])
    row, col = np.nonzero(ok)
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _joined(same: bool, k: int, kind: type):
    """A part's join: for each slot of an anchor the k best candidates whose score is within the slot's bounds."""

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return FOUND.empty_table()
        held = held.sort_by("id")
        ids, labels, x = held.column("id").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("q"), kind)
        own, own_label, q = asked.column("id").to_numpy(), asked.column("label").to_numpy(), _matrix(asked.column("q"), kind)
        slots = pc.list_value_length(asked.column("lows")).to_numpy()
        low, high = (np.full((len(own), slots.max()), fill, np.int64) for fill in (ALL, NONE))
        for name, bound in (("lows", low), ("highs", high)):
            bound[np.arange(bound.shape[1]) < slots[:, None]] = asked.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = []
        for a in range(0, len(own), BLOCK[0]):
            b = min(a + BLOCK[0], len(own))
            top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * low.shape[1]
            for c in range(0, len(ids), BLOCK[1]):
                d = min(c + BLOCK[1], len(ids))
                score = q[a:b] @ x[c:d].T
                fits = ((own_label[a:b, None] == labels[None, c:d]) == same) & (own[a:b, None] != ids[None, c:d])
                for m in range(low.shape[1]):
                    # a score under 2**53 is exact as a double, and one beyond it isn't of that kind
                    row, col = best(score, fits & (score >= low[a:b, m, None]) & (score <= high[a:b, m, None]), k)
                    row, who, value = (np.concatenate(p) for p in zip(top[m], (row, ids[c:d][col], score[row, col].astype(np.int64)), strict=True))
                    order = np.lexsort((who, -value, row))
                    row, who, value = row[order], who[order], value[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    top[m] = row[keep], who[keep], value[keep]
            out += [pa.Table.from_arrays([pa.array(own[a:b][row]), pa.array(np.full(len(row), m, np.int32)), pa.array(who), pa.array(value)], schema=FOUND) for m, (row, who, value) in enumerate(top)]
        return pa.concat_tables(out)

    return find


def grouped(pivots: np.ndarray, count: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """For each cell its first group and over how many its anchors are dealt: neighbouring cells together up to ``size`` anchors."""
    left, at, plan, group, filled = set(count), min(count, default=0), {}, 0, 0
    while left:
        at = min(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        left.remove(at)
        parts = -(-count[at] // size)
        if filled and (parts > 1 or filled + count[at] > size):
            group, filled = group + 1, 0
        plan[at] = group, parts
        filled += count[at]
        if parts > 1:
            group, filled = group + parts, 0
    return plan


class Partition:
    """Pivots, as anchors, and distances from them in the space with one component more."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.pivots = pivots  # whole numbers, of a type in which products are exact: a candidate's cell is the same in every task
        self.squares = (pivots.astype(float) ** 2).sum(axis=1)
        self.base = longest + self.squares
        #: Rounding of a squared distance is under this one's square.
        self.slack = 1e-7 * float(np.sqrt(max(1.0, self.base.max())))

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.base - 2.0 * (x @ self.pivots.T)))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (q.astype(float) ** 2).sum(axis=1)[:, None] + self.squares - 2.0 * (q @ self.pivots.T)))


def usable(vectors: DataFrame, anchors: Column, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v, anchor) of the rows that take part, their components times ``scale`` rounded down, still as doubles."""
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    return rows.where("id is not null and label is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity'))")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", group: int | None = None, part: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor's positives the first negatives.

    A score is the inner product of two vectors whose components are floor(``scale`` * x). The positives of an anchor (a
    row for which ``anchors`` is true) are its first so many other rows of the same label, by score, ties to the smaller
    id. A positive's negatives are the first so many rows of other labels, in that order, whose score is from ``low`` to
    ``high`` hundredths of the positive's: none where that is below zero.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part, nor do vectors
    of a length other than the commonest (on a tie, the shorter), nor those with a component so large (beyond the root of
    2**62 over the length) that a score may not fit 64 bits. Of rows repeated under one id the least vector counts (then
    the least label). Fewer candidates give fewer rows; without anchors there are none. Other columns are not read.

    The result is exact. What is copied to several groups depends on how far the bounds reach: an anchor whose label has
    too few rows looks everywhere. ``group`` and ``part`` set the anchors of a group and the candidates of a part.
    """
    assert 0 <= low < high <= 100 and positives > 0 and negatives > 0
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    rows = usable(vectors, anchors, scale, id_col, label_col, vector_col)
    dim = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dim:
        return spark.createDataFrame([], OUT_DDL)
    dim = dim[0]["d"]
    largest = int((2**62 / dim) ** 0.5)
    fit = rows.where((F.size("v") == dim) & F.expr(f"not exists(v, e -> abs(e) >= {largest}D)"))
    whole = fit.select("id", "label", F.transform("v", lambda e: F.floor(e).cast("int" if largest < 1 << 31 else "long")).alias("q"), "anchor")
    rows = scratch.save(whole.groupBy("id").agg(F.min(F.struct("q", "label", "anchor")).alias("r")).select("id", "r.label", "r.q", "r.anchor"), "rows")
    square = F.aggregate("q", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    top = F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))
    told = rows.agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("a"), F.max(square).alias("longest"), F.max(top).alias("top")).first()
    if not told["a"]:
        return spark.createDataFrame([], OUT_DDL)
    total, asking = told["n"], told["a"]
    kind = np.float64 if told["top"] ** 2 * dim < 1 << 53 else np.int64
    size = group or min(GROUP[1], max(GROUP[0], asking // 256))
    most = part or min(PART[1], max(PART[0], 4 * size))
    chosen = rows.where("anchor").orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, int(np.ceil(asking**0.5)))).collect()
    cells = spark.sparkContext.broadcast(Partition(np.array([r["q"] for r in chosen], kind), float(told["longest"])))

    @tidy
    def place(batches):
        for b in batches:
            d = cells.value.of_anchors(_matrix(b.column("q"), kind))
            cell = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "radius"])

    @tidy
    def tally(batches):
        for b in batches:
            n = np.bincount(np.argmin(cells.value.of_candidates(_matrix(b.column(0), kind)), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], names=["cell", "n"])

    q_type = rows.schema["q"].dataType.simpleString()
    placed = scratch.save(rows.where("anchor").select("id", "label", "q", square.alias("square")).mapInArrow(place, f"id long, label long, q {q_type}, square double, cell int, radius double"), "anchors")
    count = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = grouped(cells.value.pivots.astype(float), count, size)
    groups = 1 + max(first + n - 1 for first, n in plan.values())
    held = spark.createDataFrame([(c, first, n) for c, (first, n) in plan.items()], "cell int, first int, parts int")
    dealt = placed.join(F.broadcast(held), "cell").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int")).drop("first", "parts")
    inside = np.zeros((len(chosen), groups), bool)
    for c, (first, n) in plan.items():
        inside[c, first : first + n] = True
    near = {r["cell"]: r["n"] for r in rows.select("q").mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    own_parts = [max(1, -(-sum(n for c, n in near.items() if inside[c, g]) // most)) for g in range(groups)]
    all_parts = [max(1, -(-total // most))] * groups

    def send(bounds: list | None, parts: list[int]):
        """A copy of each candidate for the groups of its own cell, or for those of the others that ``bounds`` let it serve."""
        share = np.array(parts)
        if bounds:
            bounds = sorted(bounds, key=lambda r: r["group"])
            of, cell, least, reach = (np.array([r[c] for r in bounds]) for c in ("group", "cell", "least", "reach"))
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))

        def copies(batches):
            space = cells.value
            for whole in batches:
                for a in range(0, whole.num_rows, 1024):
                    b = whole.slice(a, 1024)
                    d = space.of_candidates(_matrix(b.column("q"), kind))
                    mine = inside[np.argmin(d, axis=1)]
                    if bounds is None:
                        go = mine
                    else:
                        at = d[:, cell]
                        go = np.zeros((len(d), groups), bool)
                        go[:, of[begin]] = np.logical_or.reduceat((at <= reach + space.slack) & (at >= least - space.slack), begin, axis=1)
                        go &= ~mine
                    row, to = np.nonzero(go)
                    deal = b.column("deal").to_numpy()
                    for i in range(0, len(row), 8192):
                        r, g = row[i : i + 8192], to[i : i + 8192]
                        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array((deal[r] % share[g]).astype(np.int32)), *(b.column(c).take(pa.array(r)) for c in ("id", "label", "q"))], names=["group", "part", "id", "label", "q"])

        return tidy(copies)

    def searched(asked: DataFrame, same: bool, k: int, own: bool) -> DataFrame | None:
        """``asked``: anchors with the bounds of each slot (lows, highs)."""
        parts, bounds = own_parts if own else all_parts, None
        if not own:
            away = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.lit(float(told["longest"])) + F.col("square") - 2.0 * score.cast("double")))
            least, reach = F.min(away(F.array_max("highs")) - F.col("radius")), F.max(F.col("radius") + away(F.array_min("lows")))
            bounds = asked.groupBy("group", "cell").agg(least.alias("least"), reach.alias("reach")).collect()
            if groups == 1 or not bounds:
                return None
        sent = rows.select("id", "label", "q", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)).alias("deal")).mapInArrow(send(bounds, parts), f"group int, part int, id long, label long, q {q_type}")
        share = F.element_at(F.array(*[F.lit(n) for n in parts]), F.col("group") + 1) if own else F.lit(all_parts[0])
        out = asked.select("group", F.explode(F.sequence(F.lit(0), share - 1)).alias("part"), "id", "label", "q", "lows", "highs")
        return out.groupBy("group", "part").cogroup(sent.groupBy("group", "part")).applyInArrow(_joined(same, k, kind), FOUND_DDL)

    def firsts(found: DataFrame, k: int) -> DataFrame:
        """(anchor_id, slot, found): the first k of what all parts found."""
        order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id")))
        return found.groupBy("anchor_id", "slot").agg(F.slice(order, 1, k).alias("found"))

    def both(asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """Own cells first; then the others, each slot's lower bound raised to its k-th best so far."""
        own = scratch.save(firsts(searched(asked, same, k, True), k), name)
        if groups == 1:
            return own
        full = own.where(F.size("found") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", (-F.element_at("found", -1)["down"]).alias("s")))).alias("__k"))
        raised = F.transform("lows", lambda v, i: F.coalesce(F.try_element_at(F.col("__k"), i), v))
        tight = asked.join(full.withColumnRenamed("anchor_id", "id"), "id", "left").withColumn("lows", raised).drop("__k")
        more = searched(tight, same, k, False)
        if more is None:
            return own
        flat = own.select("anchor_id", "slot", F.explode("found").alias("f")).select("anchor_id", "slot", F.col("f.id").alias("id"), (-F.col("f.down")).alias("score"))
        return scratch.save(firsts(flat.unionByName(more), k), name)

    lone = dealt.withColumns({"lows": F.array(F.lit(NONE + 1)), "highs": F.array(F.lit(ALL))})
    liked = both(lone, True, positives, "positives").select("anchor_id", F.transform("found", lambda f: F.struct(f["id"].alias("id"), (-f["down"]).alias("score"))).alias("liked"))
    hundredths = lambda s, n, up: F.lit(n) * F.call_function("div", s, F.lit(100)) + F.call_function("div", F.lit(n) * (s % 100) + F.lit(99 if up else 0), F.lit(100))
    liked = scratch.save(liked.withColumn("liked", F.filter("liked", lambda f: f["score"] >= 0)).where(F.size("liked") > 0), "liked")
    bands = {"lows": F.transform("liked", lambda f: hundredths(f["score"], low, True)), "highs": F.transform("liked", lambda f: hundredths(f["score"], high, False))}
    asked = dealt.join(liked.withColumnRenamed("anchor_id", "id"), "id").withColumns(bands).drop("liked")
    wrong = both(asked, False, negatives, "negatives").join(liked, "anchor_id").withColumn("p", F.get("liked", F.col("slot")))
    flat = wrong.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("found").alias("n", "f"))
    return flat.select("anchor_id", "positive_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", (-F.col("f.down")).alias("negative_score"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
