"""Mutual information of continuous columns from the distances of nearest neighbours.

For each pair (x, y), both over their (population) deviation, the radius is the distance, in the larger of both
directions, to its k-th nearest other pair. With m(x) and m(y) pairs, itself among them, nearer than the radius in x alone
and in y alone, the estimate is digamma(n) + digamma(k) - mean(digamma(m(x))) - mean(digamma(m(y))), or 0 if that is less.

Ties are broken as follows. No noise is added. A pair counts as nearer in one direction if its distance is under the
radius by more than a billionth of it; a radius of zero counts the equal values.

Equal pairs are one point with a weight. Points are dealt into cells of a grid (strips of x cut by y, between quantiles),
where each looks for its neighbours; one whose radius reaches over its cell's border also asks the cells that it reaches.
Marginal counts are looked up in sorted slices of the distinct values, with what the slices before hold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel import Panel
from ..functions.slices import ROWS, sliced

#: Points of a cell (more where there would be too many cells), and lookups of a slice that one task answers.
CELL = 20_000
#: By how much of the radius a pair must be nearer in one direction.
TIE = 1e-9


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = sum(1 / (x + i) for i in range(10))
    z = x + 10
    w = 1 / (z * z)
    return np.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132)))) - shift


def nearest(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k points nearest to each query but equal to it, infinite where there are fewer (or none nearer than ``limit``).

    x is ascending: a query goes along it in both directions until the way in x is as long as its k-th distance.
    """
    best = np.full((len(qx), k), np.inf) if limit is None else np.repeat(np.asarray(limit, float)[:, None], k, axis=1)
    place = np.full((len(qx), k), -1)
    right = np.searchsorted(x, qx)
    for step, at in ((1, right.copy()), (-1, right - 1)):
        who = np.arange(len(qx))
        while len(who):
            p = at[who]
            who = who[(p >= 0) & (p < len(x))]
            p = at[who]
            way = np.abs(x[p] - qx[who])
            go = way < best[who, -1]
            who, p, way = who[go], p[go], way[go]
            d = np.maximum(way, np.abs(y[p] - qy[who]))
            nearer = (d < best[who, -1]) & (d > 0)
            hit = who[nearer]
            both = np.concatenate([best[hit], d[nearer, None]], axis=1)
            order = np.argsort(both, axis=1, kind="stable")[:, :k]
            best[hit] = np.take_along_axis(both, order, 1)
            place[hit] = np.take_along_axis(np.concatenate([place[hit], p[nearer, None]], axis=1), order, 1)
            at[who] += step
    return np.where(place < 0, np.inf, best), place


def weighted(distance: np.ndarray, weight: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The distance of the k-th nearest other pair: of neighbours in order, each standing for so many, and ``own`` equal ones."""
    have = (own - 1)[:, None] + np.cumsum(np.where(np.isfinite(distance), weight, 0), axis=1)
    reached = have >= k
    first = np.where(reached.any(axis=1), np.take_along_axis(distance, np.argmax(reached, axis=1)[:, None], 1)[:, 0], np.inf)
    return np.where(own > k, 0.0, first)


def radii(points: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """``points`` (feature, x, y, c: distinct, with weights) with ``r``, the distance of the k-th nearest other pair."""
    spark = points.sparkSession
    n = points.groupBy("feature").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    strips = sliced(points, Panel(("feature",), ("x",)), max(cell, int((n * cell) ** 0.5)))
    cut = sliced(strips.df.withColumnRenamed("__slice", "__strip"), Panel(("feature", "__strip"), ("y",)), cell)
    placed = cut.df.withColumnRenamed("__slice", "__cell")
    keys = ["feature", "__strip", "__cell"]
    borders = spark.sparkContext.broadcast((strips.bounds, cut.bounds))
    schema = T.StructType([*placed.schema.fields, T.StructField("d", T.ArrayType(T.DoubleType())), T.StructField("w", T.ArrayType(T.LongType())), T.StructField("r", T.DoubleType())])

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        x, y, c = (pdf[n].to_numpy() for n in ("x", "y", "c"))
        d, place = nearest(x, y, x, y, k)
        w = np.where(place < 0, 0, c[place])
        return pdf.assign(d=list(d), w=list(w), r=weighted(d, w, c, k))[schema.names]

    def reached(bounds: list, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.asarray(bounds, float)
        return np.searchsorted(b, v - r), np.searchsorted(b, v + r)

    def visits(batches):
        """Of each point, the other cells that its radius reaches."""
        strip_of, cell_of = borders.value
        for pdf in batches:
            out = []
            for f, part in pdf.groupby("feature", sort=False):
                low, high = reached(strip_of.get((f,), []), part["x"].to_numpy(), part["r"].to_numpy())
                inside = (low == high) & (low == part["__strip"].to_numpy())
                for strip, own in part[inside].groupby("__strip", sort=False):
                    under, over = reached(cell_of.get((f, strip), []), own["y"].to_numpy(), own["r"].to_numpy())
                    at = own["__cell"].to_numpy()
                    part = part.drop(own.index[(under == at) & (over == at)])  # most points reach no border
                low, high = reached(strip_of.get((f,), []), part["x"].to_numpy(), part["r"].to_numpy())
                for s, c, x, y, r, i, j in zip(*(part[n] for n in ("__strip", "__cell", "x", "y", "r")), low, high, strict=True):
                    for to in range(i, j + 1):
                        under, over = reached(cell_of.get((f, to), []), y, r)
                        out += [(f, to, at, x, y, r) for at in range(under, over + 1) if (to, at) != (s, c)]
            yield pd.DataFrame(out, columns=[*keys, "x", "y", "r"])

    def more(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        x, y, c = (pdf[n].to_numpy() for n in ("x", "y", "c"))
        # a point at the radius exactly changes nothing
        d, place = nearest(x, y, asked["x"].to_numpy(), asked["y"].to_numpy(), k, asked["r"].to_numpy())
        found = np.isfinite(d).any(axis=1)
        w = np.where(place < 0, 0, c[place] if len(c) else 0)
        return pd.DataFrame({"feature": asked["feature"][found], "x": asked["x"][found], "y": asked["y"][found], "d": pd.Series(list(d[found]), asked.index[found], object), "w": pd.Series(list(w[found]), asked.index[found], object)})

    near = placed.groupBy(*keys).applyInPandas(own, schema)
    if not (strips.bounds or cut.bounds):
        return near.select("feature", "x", "y", "c", "r")
    asked = near.select(*keys, "x", "y", "r").mapInPandas(visits, "feature string, __strip int, __cell int, x double, y double, r double")
    cells = placed.select(*[F.col(c).alias(c) for c in placed.columns])
    found = cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(more, "feature string, x double, y double, d array<double>, w array<long>")
    every = near.select("feature", "x", "y", "c", "d", "w").unionByName(found.withColumn("c", F.lit(0).cast("long")))

    def merged(batches):
        for pdf in batches:
            r = []
            for ds, ws, c in zip(pdf["d"], pdf["w"], pdf["c"], strict=True):
                d, w = np.concatenate(list(ds)), np.concatenate(list(ws))
                order = np.argsort(d, kind="stable")
                r.append(weighted(d[order][None], w[order][None], np.array([c]), k)[0])
            yield pdf[["feature", "x", "y", "c"]].assign(r=r)

    # a point has k neighbours of its own cell and of each that it reaches
    whole = every.groupBy("feature", "x", "y").agg(F.max("c").alias("c"), F.collect_list("d").alias("d"), F.collect_list("w").alias("w"))
    return whole.mapInPandas(merged, "feature string, x double, y double, c long, r double")


def counts_within(values: DataFrame, asked: DataFrame, rows: int = ROWS) -> DataFrame:
    """``asked`` (feature, axis, v, r and others) with ``m``: how many of ``values`` (feature, axis, v, c: distinct, with weights) lie nearer than r to v."""
    keys, ids = ["feature", "axis"], [c for c in asked.columns if c not in ("v", "r")]
    s = sliced(values, Panel(tuple(keys), ("v",)), rows)
    per: dict[tuple, dict[int, int]] = {}
    for q in s.df.groupBy(*keys, "__slice").agg(F.sum("c").alias("n")).collect():  # a row for each slice
        per.setdefault((q["feature"], q["axis"]), {})[q["__slice"]] = q["n"]
    before = [(*key, i, sum(n for j, n in own.items() if j < i)) for key, own in per.items() for i in range(len(s.bounds.get(key, [])) + 1)]
    held = values.sparkSession.createDataFrame(before, T.StructType([*[values.schema[k] for k in keys], T.StructField("__slice", T.IntegerType()), T.StructField("__before", T.LongType())]))
    reach = F.col("r") * (1 - TIE)
    ends = F.array(F.struct((F.col("v") + reach).alias("q"), (F.col("r") == 0).alias("upto"), F.lit(1).alias("sign")), F.struct((F.col("v") - reach).alias("q"), (F.col("r") > 0).alias("upto"), F.lit(-1).alias("sign")))
    lookups = s.cut(asked.select(*ids, F.explode(ends).alias("e")).select(*ids, "e.*"), "q")
    # a slice's lookups are answered in parts of about ``rows``; its values are copied to each
    load = lookups.groupBy(*keys, "__slice").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    lookups = lookups.join(F.broadcast(held), [*keys, "__slice"]).join(load, [*keys, "__slice"]).withColumn("__part", F.pmod(F.xxhash64(*ids, "sign"), "parts").cast("int")).drop("parts")
    copies = s.df.join(load, [*keys, "__slice"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = T.StructType([*[asked.schema[c] for c in ids], T.StructField("m", T.LongType())])

    def look(pdf: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, total = pdf["v"].to_numpy(), np.concatenate([[0], np.cumsum(pdf["c"].to_numpy())])
        q = queries["q"].to_numpy()
        at = np.where(queries["upto"].to_numpy(bool), np.searchsorted(v, q, "right"), np.searchsorted(v, q, "left"))
        return queries[ids].assign(m=queries["sign"].to_numpy() * (queries["__before"].to_numpy() + total[at]))

    keyed = [*keys, "__slice", "__part"]
    lookups, copies = (d.select(*[F.col(n).alias(n) for n in d.columns]) for d in (lookups, copies))
    return copies.groupBy(*keyed).cogroup(lookups.groupBy(*keyed)).applyInPandas(look, schema).groupBy(*ids).agg(F.sum("m").alias("m"))


def neighbour_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3, cell: int = CELL, rows: int = ROWS) -> DataFrame:
    """(feature, n, mi): the mutual information of each column and the target, over the n rows that know both; NULL for k rows or fewer."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(c) < float("inf"))
    wide = df.select(*[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)], F.col(target).cast("double").alias("y"))
    pairs = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__{i}").alias("x")) for i, c in enumerate(columns)])).alias("p"), "y").select("p.feature", "p.x", "y").where(known("x") & known("y"))
    size = pairs.groupBy("feature").agg(F.count("*").alias("n"), *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s{c}") for c in ("x", "y")]).collect()  # a row for each column
    if not size:
        return df.sparkSession.createDataFrame([], "feature string, n long, mi double")
    sizes = df.sparkSession.createDataFrame(size, "feature string, n long, sx double, sy double")
    points = pairs.join(F.broadcast(sizes), "feature").select("feature", (F.col("x") / F.col("sx") + 0.0).alias("x"), (F.col("y") / F.col("sy") + 0.0).alias("y")).groupBy("feature", "x", "y").agg(F.count("*").alias("c"))
    near = radii(points, k, cell).where(F.col("r") < float("inf"))
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v"))))
    values = points.select("feature", "c", axes.alias("a")).groupBy("feature", "a.axis", "a.v").agg(F.sum("c").alias("c"))
    asked = near.select("feature", "x", "y", "c", "r", axes.alias("a")).select("feature", "x", "y", "c", "a.axis", "a.v", "r")
    m = counts_within(values, asked, rows)

    def summed(batches):
        for pdf in batches:
            yield pd.DataFrame({"feature": pdf["feature"], "t": pdf["c"] * digamma(pdf["m"])})

    total = m.mapInPandas(summed, "feature string, t double").groupBy("feature").agg(F.sum("t").alias("t"))
    psi = {r["feature"]: (float(digamma(r["n"])) + float(digamma(k)), r["n"]) for r in size}
    base = df.sparkSession.createDataFrame([(f, n, p) for f, (p, n) in psi.items()], "feature string, n long, p double")
    estimate = F.greatest(F.lit(0.0), F.col("p") - F.col("t") / F.col("n"))
    return base.join(total, "feature", "left").select("feature", "n", F.when(F.col("n") > k, estimate).alias("mi"))
