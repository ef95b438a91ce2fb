"""Interpolating splines of any degree, with one knot at or between the points and none next to the ends.

The coefficients of the B-splines solve a banded system, whose matrix is totally positive, as are its diagonal blocks: so
blocks are solved by themselves, for the right side and for their couplings to the last and first few coefficients of
their neighbours, and a small system of these few couples them. Within a task the blocks are 64 rows and solved at once;
over tasks they are slices of a series, of which the driver sees the few numbers that couple them.

For an odd degree the knots are the points but those next to the ends, for an even one the points halfway between.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .panel import Panel
from .slices import ROWS, _same, sliced

#: Rows of a block that is solved densely.
BLOCK = 64


class Points:
    """Places of a series' points, or of some in a row of them: ``x[0]`` is the one of number ``base``, of ``n`` in all."""

    def __init__(self, x: np.ndarray, degree: int, base: int = 0, n: int | None = None):
        self.x, self.base, self.n = x, base, len(x) if n is None else n
        self.k = k = max(0, min(degree, self.n - 1))
        q = np.arange(base, base + len(x) + k + 1)
        at = lambda i: x[np.clip(i - base, 0, len(x) - 1)]
        inner = at(q - (k + 1) // 2) if k % 2 else (at(q - k // 2 - 1) + at(q - k // 2)) / 2
        self.q0, self.knots = base, np.where(q <= k, at(np.zeros_like(q)), np.where(q >= self.n, at(np.full_like(q, self.n - 1)), inner))

    def basis(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the first of the k + 1 B-splines that may not be zero at each place, and their values."""
        k = self.k
        m = np.clip(self.q0 + np.searchsorted(self.knots, u, "right") - 1, k, self.n - 1)
        knot = lambda i: self.knots[np.clip(i - self.q0, 0, len(self.knots) - 1)]
        left, right = ([None, *[f(j) for j in range(1, k + 1)]] for f in (lambda j: u - knot(m + 1 - j), lambda j: knot(m + j) - u))
        value = [np.ones(len(u))]
        for j in range(1, k + 1):
            saved = np.zeros(len(u))
            for r in range(j):
                part = value[r] / (right[r + 1] + left[j - r])
                value[r] = saved + right[r + 1] * part
                saved = left[j - r] * part
            value.append(saved)
        return m - k, np.stack(value, axis=1)

    def bands(self, a: int, b: int) -> np.ndarray:
        """[point, k + column - point] of the points of numbers [a, b)."""
        first, value = self.basis(self.x[a - self.base : b - self.base])
        out = np.zeros((b - a, 2 * self.k + 1))
        for j in range(self.k + 1):
            column = first + j - np.arange(a, b) + self.k
            ok = (column >= 0) & (column <= 2 * self.k)
            out[np.flatnonzero(ok), column[ok]] = value[ok, j]
        return out

    def at(self, u: np.ndarray, coefficients: np.ndarray, base: int) -> np.ndarray:
        """The spline at each place; ``coefficients[0]`` is that of number ``base``."""
        first, value = self.basis(u)
        index = np.clip(first[:, None] + np.arange(self.k + 1) - base, 0, len(coefficients) - 1)
        return (value * coefficients[index]).sum(axis=1)


def coupled(r: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The first and last w unknowns of each block: u[j] + before[j] last(u[j - 1]) + after[j] first(u[j + 1]) = r[j]."""
    w, known, follow = before.shape[2], [r[0]], [after[0]]
    one = np.eye(2 * w)
    for j in range(1, len(r)):
        m = one.copy()
        m[:, :w] -= before[j] @ follow[-1][w:]
        both = np.linalg.solve(m, np.concatenate([r[j] - before[j] @ known[-1][w:], after[j]], axis=1))
        known.append(both[:, : r.shape[2]])
        follow.append(both[:, r.shape[2] :])
    out = np.empty_like(r)
    out[-1] = known[-1]
    for j in range(len(r) - 2, -1, -1):
        out[j] = known[j] - follow[j] @ out[j + 1][:w]
    return out


def solved(bands: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution of a banded system for the columns of ``rhs``, in blocks; what reaches beyond the rows is left out."""
    n, w, c = len(bands), bands.shape[1] // 2, rhs.shape[1]
    if w == 0:
        return rhs / bands
    size = max(BLOCK, 4 * w)
    g = -(-n // size)
    held = np.zeros((g * size, 2 * w + 1))
    held[:n], held[n:, w] = bands, 1.0
    held = held.reshape(g, size, 2 * w + 1)
    dense, rows = np.zeros((g, size, size)), np.arange(size)
    sides = np.zeros((g, size, c + 2 * w))
    flat = np.zeros((g * size, c))
    flat[:n] = rhs
    sides[:, :, :c] = flat.reshape(g, size, c)
    for d in range(-w, w + 1):
        to = rows + d
        here = (to >= 0) & (to < size)
        dense[:, rows[here], to[here]] = held[:, rows[here], w + d]
        for r in rows[to < 0]:
            sides[1:, r, c + w + r + d] = held[1:, r, w + d]
        for r in rows[to >= size]:
            sides[:-1, r, c + w + r + d - size] = held[:-1, r, w + d]
    x = np.linalg.solve(dense, sides)
    if g == 1:
        return x[0, :n, :c]
    edge = np.concatenate([x[:, :w], x[:, -w:]], axis=1)
    u = coupled(edge[:, :, :c], edge[:, :, c : c + w], edge[:, :, c + w :])
    out = x[:, :, :c].copy()
    out[1:] -= x[1:, :, c : c + w] @ u[:-1, w:]
    out[:-1] -= x[:-1, :, c + w :] @ u[1:, :w]
    return out.reshape(g * size, c)[:n]


def spline(x: np.ndarray, y: np.ndarray, u: np.ndarray, degree: int) -> np.ndarray:
    """The spline through points of ascending places x, at u; before the first and after the last point it is these' value."""
    points = Points(x, degree)
    made = points.at(u, solved(points.bands(0, len(x)), y[:, None])[:, 0], 0)
    return np.where(u <= x[0], y[0], np.where(u >= x[-1], y[-1], made))


def _sliced_solution(points: Points, a: int, b: int, y: np.ndarray) -> np.ndarray:
    """[own point, (y, couplings to the last coefficients before, to the first after)]."""
    bands, w = points.bands(a, b), points.k
    sides = np.zeros((b - a, 1 + 2 * w))
    sides[:, 0] = y
    for r in [*range(min(w, b - a)), *range(max(w, b - a - w), b - a)]:
        for d in range(-w, w + 1):
            if r + d < 0:
                sides[r, 1 + w + r + d] = bands[r, w + d]
            elif r + d >= b - a:
                sides[r, 1 + w + r + d - (b - a)] = bands[r, w + d]
    return solved(bands, sides)


def spline_filled(df: DataFrame, panel: Panel, columns: list[str], degree: int, rows: int = ROWS) -> DataFrame:
    """Missing values of ``columns`` from the spline over the row's number in its series; before the first known value and after the last one, that.

    With n known values the degree is n - 1 at most; a series without any stays as it is. Series of more than ``rows``
    rows are worked on slice by slice. The columns become doubles.
    """
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in df.schema.fields])
    s, by = sliced(df, panel, rows), list(panel.by)
    if not s.starts:

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(list(panel.time), kind="stable", na_position="first")
            for c in columns:
                x = pdf[c].astype(float).to_numpy()
                known = np.flatnonzero(~np.isnan(x))
                if 0 < len(known) < len(x):
                    x = np.where(np.isnan(x), spline(known.astype(float), x[known], np.arange(len(x), dtype=float), degree), x)
                pdf = pdf.assign(**{c: x})
            return pdf[schema.names]

        return df.groupBy(*by).applyInPandas(one, schema)
    out = s.numbered().withColumnRenamed("__row", "__t").drop("__slice")
    for c in columns:
        out = _filled_in_slices(out, by, c, degree, rows)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def _filled_in_slices(df: DataFrame, by: list[str], c: str, degree: int, rows: int) -> DataFrame:
    """One column of rows numbered by ``__t``."""
    keys = [df.schema[k] for k in by]
    known = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).select(*by, "__t", F.col(c).cast("double").alias("__x"))
    s = sliced(known, Panel(tuple(by), ("__t",)), rows)
    halo = 2 * degree + 2
    whole = F.count(F.when(F.col("__own"), 1)).over(s.inner.whole)
    points = s._told(s.with_halo(halo, halo), [T.StructField("__n", T.LongType())], lambda _, starts: [(starts[-1],)], False) if s.starts else s.numbered().withColumns({"__own": F.lit(True), "__n": F.lit(None).cast("long")})
    points = points.withColumn("__n", F.coalesce("__n", whole))

    def read(pdf: pd.DataFrame) -> tuple[Points, int, int, np.ndarray]:
        pdf = pdf.sort_values("__row")
        own = pdf.loc[pdf["__own"], "__row"]
        a, b, base = int(own.iloc[0]), int(own.iloc[-1]) + 1, int(pdf["__row"].iloc[0])
        p = Points(pdf["__t"].to_numpy(float), degree, base, int(pdf["__n"].iloc[0]))
        return p, a, b, pdf["__x"].to_numpy(float)[a - base : b - base]

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        p, a, b, y = read(pdf)
        z, w = _sliced_solution(p, a, b, y), p.k
        assert b - a >= w
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in [*by, "__slice"]}, "__edge": [np.concatenate([z[:w], z[len(z) - w :]]).ravel()]})

    inner = [*keys, T.StructField("__slice", T.IntegerType())]
    told: dict[tuple, dict[int, np.ndarray]] = {}
    if s.starts:
        marked = s._told(points, [T.StructField("__long", T.BooleanType())], lambda *_: [(True,)], False).where("__long").drop("__long")
        for r in marked.groupBy(*by, "__slice").applyInPandas(edges, T.StructType([*inner, T.StructField("__edge", T.ArrayType(T.DoubleType()))])).collect():  # a row for each slice
            told.setdefault(tuple(r[: len(by)]), {})[r["__slice"]] = np.array(r["__edge"]).reshape(2 * degree, 1 + 2 * degree)
    beside = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("__before", "__after")]
    rows_of = []
    for key, per in told.items():
        order = sorted(per)
        e = np.array([per[i] for i in order])
        u = coupled(e[:, :, :1], e[:, :, 1 : 1 + degree], e[:, :, 1 + degree :])[:, :, 0]
        rows_of += [(*key, at, u[i - 1, degree:].tolist() if i else None, u[i + 1, :degree].tolist() if i + 1 < len(order) else None) for i, at in enumerate(order)]
    held = df.sparkSession.createDataFrame(rows_of, T.StructType([*[T.StructField(f"__k_{k.name}", k.dataType) for k in keys], T.StructField("__at", T.IntegerType()), *beside]))
    points = points.join(F.broadcast(held), _same(by) & (F.col("__slice") == F.col("__at")), "left").drop("__at", *[f"__k_{k}" for k in by])
    gaps = s.cut(df.where(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).select(*by, "__t"), "__t")

    def fill(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = asked[[*by, "__t"]].assign(__v=np.nan)
        if not len(pdf) or not len(asked):
            return out
        p, a, b, y = read(pdf)
        z, w, none = _sliced_solution(p, a, b, y), p.k, np.zeros(p.k)
        before, after = (none if v is None else np.asarray(v, float)[:w] for v in (pdf["__before"].iloc[0], pdf["__after"].iloc[0]))
        own = z[:, 0] - z[:, 1 : 1 + w] @ before - z[:, 1 + w :] @ after
        u = asked["__t"].to_numpy(float)
        made = p.at(u, np.concatenate([before, own, after]), a - w)
        if a == 0:
            made = np.where(u <= p.x[0], y[0], made)
        if b == p.n:
            made = np.where(u >= p.x[-1], y[-1], made)
        return out.assign(__v=made)

    points, gaps = (d.select(*[F.col(n).alias(n) for n in d.columns]) for d in (points, gaps))  # both come from one table: columns of their own
    got = points.groupBy(*by, "__slice").cogroup(gaps.groupBy(*by, "__slice")).applyInPandas(fill, T.StructType([*keys, T.StructField("__t", T.LongType()), T.StructField("__v", T.DoubleType())]))
    got = got.withColumnsRenamed({k: f"__k_{k}" for k in by} | {"__t": "__u"})
    return df.join(got, _same(by) & (F.col("__t") == F.col("__u")), "left").withColumn(c, F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.col("__v"))).drop("__v", "__u", *[f"__k_{k}" for k in by])
