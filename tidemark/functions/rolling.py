"""Order statistics of the last n rows, in Arrow batches: no array of n values is laid out for a row.

Rows of a series come in order to one task (``slices.in_slices`` cuts long ones), which keeps the last n rows of the
inputs from one batch to the next and works on whole batches with numpy: ranks and quantiles by a wavelet matrix, in as
many steps as a batch's distinct values have bits; drawdowns by combining spans of doubling length, in as many as n has.
Both so take a time that hardly depends on n. Rank correlations keep the ranks of many windows at once and update them
as rows come and go; their time grows with n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .panel import Panel, series_edges


class Wavelet:
    """The order of values within any range of places: one bit of the values' ranks at a time, places regrouped by it."""

    def __init__(self, values: np.ndarray):
        self.values, self.ranks = np.unique(values, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        now = self.ranks
        for bit in reversed(range(max(1, (len(self.values) - 1).bit_length()))):
            zero = (now >> bit & 1) == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((bit, before, int(before[-1])))
            now = np.concatenate([now[zero], now[~zero]])

    def less(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the places [low, high) have a lesser rank, and how many that rank."""
        out, low, high = np.zeros(len(low), np.int64), low.copy(), high.copy()
        for bit, before, zeros in self.levels:
            a, b, one = before[low], before[high], (rank >> bit & 1) == 1
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return out, high - low

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value (from 0) at the places [low, high), which must have so many."""
        rank, low, high, k = np.zeros(len(low), np.int64), low.copy(), high.copy(), k.copy()
        for bit, before, zeros in self.levels:
            a, b = before[low], before[high]
            one = k >= b - a
            rank |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return self.values[rank]


def rolled(df: DataFrame, panel: Panel, carry: int, inputs: Sequence[str], outputs: Sequence[str], fn: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Adds double columns: ``fn`` gets the inputs as doubles (NaN: unknown) and the place at which each row's series begins.

    It sees ``carry`` rows before a batch, and gives a value for every row that it sees.
    """
    by = list(panel.by)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in outputs]])

    def fold(batches):
        held, begun = {c: np.zeros(0) for c in inputs}, np.zeros(0, np.int64)  # of the last rows; and how long their series has been
        for batch, cuts, begins, _ in series_edges(batches, by):
            new = {c: batch.column(batch.schema.get_field_index(c)).cast("double").to_numpy(zero_copy_only=False) for c in inputs}
            n, old = batch.num_rows, len(begun)
            values = {c: np.concatenate([held[c], new[c]]) for c in inputs}
            first = np.zeros(old + n, np.int64)
            if begins[0]:
                first[old:] = old
            for a, is_new in zip(cuts[:-1], begins, strict=True):
                if is_new:
                    first[old + a :] = old + a
            first[:old] = begun
            got = fn(values, first)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[c][old:], from_pandas=True) for c in outputs)], names=[*batch.schema.names, *outputs])
            start = max(int(first[-1]), old + n - carry)  # only rows of the last series are kept
            held, begun = {c: v[start:] for c, v in values.items()}, np.zeros(old + n - start, np.int64)

    return df.repartition(*by).sortWithinPartitions(*by, *panel.time).mapInArrow(fold, schema)


def _windows(first: np.ndarray, n: int, *known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the window of n rows that ends at each row begins, and whether it is whole and known."""
    at = np.arange(len(first))
    low = np.maximum(first, at - n + 1)
    full = at - low + 1 == n
    for x in known:
        count = np.concatenate([[0], np.cumsum(~np.isnan(x))])
        full &= count[at + 1] - count[low] == n
    return low, full


def rank_pct(df: DataFrame, panel: Panel, columns: dict[str, str], n: int) -> DataFrame:
    """Adds {output: column}: the value's rank in the last n rows, ties averaged, over n; NULL until n are known."""

    def ranks(values, first):
        out = {}
        for name, c in columns.items():
            x = values[c]
            low, full = _windows(first, n, x)
            out[name] = np.full(len(x), np.nan)
            if full.any():
                tree = Wavelet(np.where(np.isnan(x), 0.0, x))
                less, equal = tree.less(low[full], np.flatnonzero(full) + 1, tree.ranks[full])
                out[name][full] = (less + (equal + 1) / 2) / n
        return out

    return rolled(df, panel, n - 1, sorted(set(columns.values())), list(columns), ranks)


def quantiles(df: DataFrame, panel: Panel, columns: dict[str, tuple[str, float]], n: int) -> DataFrame:
    """Adds {output: (column, share)}: the quantile of the last n rows, between neighbours in proportion; NULL until n are known."""

    def cut(values, first):
        out = {}
        for name, (c, share) in columns.items():
            x = values[c]
            low, full = _windows(first, n, x)
            out[name] = np.full(len(x), np.nan)
            if full.any():
                tree, at = Wavelet(np.where(np.isnan(x), 0.0, x)), share * (n - 1)
                a, b, k = low[full], np.flatnonzero(full) + 1, int(at)
                under = tree.kth(a, b, np.full(len(a), k))
                over = tree.kth(a, b, np.full(len(a), min(k + 1, n - 1)))
                out[name][full] = under + (over - under) * (at - k)
        return out

    return rolled(df, panel, n - 1, sorted({c for c, _ in columns.values()}), list(columns), cut)


def _joined(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Two neighbouring spans as one: product of growth, its highest and lowest on the way, the deepest fall."""
    growth, high, low, fall = a
    with np.errstate(all="ignore"):
        return [growth * b[0], np.maximum(high, growth * b[1]), np.minimum(low, growth * b[2]), np.minimum(np.minimum(fall, b[3]), growth * b[2] / high)]


def rolling_drawdown(df: DataFrame, panel: Panel, ret: str, n: int, name: str) -> DataFrame:
    """Adds the deepest fall from a high within the last n rows, of the value that these returns make; NULL until n are known, or where one is not above -1."""

    def falls(values, first):
        x = np.where(values[ret] > -1, values[ret], np.nan)
        _, full = _windows(first, n, x)
        g = np.where(np.isnan(x), 1.0, 1 + x)
        span, end, out = [g, g, g, np.ones(len(g))], np.arange(len(g)), None
        for bit in range(n.bit_length()):  # span: of 2**bit rows to each row
            if n >> bit & 1:  # the spans so far end where this one is joined on, before them
                out = [s.copy() for s in span] if out is None else _joined([s[np.maximum(end, 0)] for s in span], out)
                end = end - (1 << bit)
            before = np.maximum(np.arange(len(g)) - (1 << bit), 0)
            span = _joined([s[before] for s in span], span)
        return {name: np.where(full, out[3] - 1, np.nan)}

    return rolled(df, panel, n - 1, [ret], [name], falls)


def rank_corr(df: DataFrame, panel: Panel, x: str, y: str, n: int, least: float, name: str) -> DataFrame:
    """Adds the rank correlation of the n rows before each row, over those that know both, if there are ``least`` of them; NULL without variance."""

    def steps(values, first):
        total, both = len(first), ~(np.isnan(values[x]) | np.isnan(values[y]))
        pair = [np.where(both, values[c], np.nan) for c in (x, y)]
        lanes = max(1, total // (4 * n))
        length = -(-total // lanes)
        begin = np.arange(lanes) * length
        held, rank = np.full((2, lanes, n), np.nan), np.zeros((2, lanes, n))  # a row's rank: twice the lesser ones, and the equal ones
        out = np.full(total, np.nan)
        for s in range(-n, length):
            at = begin + s
            inside = (at >= 0) & (at < total)
            here = np.clip(at, 0, total - 1)
            fresh = inside & (first[here] == here)
            held[:, fresh], rank[:, fresh] = np.nan, 0.0
            if s >= 0 and inside.any():
                known = (~np.isnan(held[0])).sum(axis=1)
                sums, squares = rank.sum(axis=2), (rank * rank).sum(axis=2)
                spread = np.sqrt(np.maximum((known * squares[0] - sums[0] ** 2) * (known * squares[1] - sums[1] ** 2), 0.0))
                cov = known * (rank[0] * rank[1]).sum(axis=1) - sums[0] * sums[1]
                ok = inside & (known >= least) & (spread > 0)
                out[at[ok]] = cov[ok] / spread[ok]
            slot = s % n
            for j in range(2):
                now = held[j]
                old, new = now[:, slot].copy(), np.where(inside, pair[j][here], np.nan)
                rank[j] -= 2.0 * (old[:, None] < now) + (old[:, None] == now)
                now[:, slot] = new
                rank[j, :, slot] = 0.0
                rank[j] += 2.0 * (new[:, None] < now) + (new[:, None] == now)
                # the new row's own: it has just counted itself once
                rank[j, :, slot] = np.where(np.isnan(new), 0.0, (2.0 * (now < new[:, None]) + (now == new[:, None])).sum(axis=1))
        return {name: out}

    return rolled(df, panel, n, [x, y], [name], steps)
