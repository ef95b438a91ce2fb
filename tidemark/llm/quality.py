"""Quality classifier by co-training on two views: what a text says, and what its metadata say.

The text view is a logistic model over hashed words and a few shape figures (length, repetition, share of letters). The
metadata view is one over the hashed values of the other columns. Each round scores every unlabelled document by both
views; what one view is confident of becomes training data of the other. At the end each view is calibrated on held-out
labels, and a logistic model of both calibrated views gives the score of every document.

The labelled rows that a fit uses are a bounded sample (``fit_rows``, by hash of the id), and so are the pseudo-labels
that are taken over in a round (``exchange`` for each class and view); scoring covers all documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .text import U, pieces, texts, tidy, words

WORDS = 1 << 18
META = 1 << 12
SHAPE = 8


def text_view(column: pa.Array):
    """For each piece: first document, the word features of each (concatenated, with starts), the shape figures."""
    buf, off = texts(column)
    for a, b, own, begin in pieces(buf, off, 1 << 19):
        h, first = words(own, begin)
        n, size = np.diff(first), np.diff(begin)
        doc = np.repeat(np.arange(b - a), n)
        slot = (h >> U(46)).astype(np.int64)
        pair, count = np.unique(doc * WORDS + slot, return_counts=True)
        start = np.searchsorted(pair, np.arange(b - a + 1) * WORDS)
        own_of = pair // WORDS
        most = np.zeros(b - a)
        np.maximum.at(most, own_of, count)
        same = np.zeros(b - a)
        if len(h) > 1:
            np.add.at(same, doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
        per_byte = lambda is_so: np.diff(np.concatenate([[0], np.cumsum(is_so)])[begin])
        low = own | 32
        letters, digits, lines = per_byte(((low >= 97) & (low <= 122)) | (own >= 128)), per_byte((own >= 48) & (own <= 57)), per_byte(own == 10)
        share = lambda x, y: x / np.maximum(y, 1)
        shape = np.stack([np.log1p(n), share(np.diff(start), n), share(same, n), share(most, n), share(size, n) / 10, share(letters, size), share(digits, size), share(lines, n)], axis=1)
        yield a, b, pair % WORDS, start, shape


def meta_view(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """One feature for each column; numbers count by their order of magnitude, a null is a value of its own."""
    out = np.zeros((batch.num_rows, max(1, len(names))), np.int64)
    for j, name in enumerate(names):
        column, known = batch.column(batch.schema.get_field_index(name)), {}
        for i, v in enumerate(column.to_pylist()):
            if v not in known:
                k = f"{np.log2(1 + abs(v)):.0f}" if isinstance(v, (int, float)) and v == v else str(v)
                known[v] = xxhash.xxh3_64_intdigest(f"{j}={k}") % META
            out[i, j] = known[v]
    return out


class Logistic:
    """Weights over kept features of a sparse 0/1 matrix whose rows are scaled to length one, and over dense figures."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int, least: int, l2: float, steps: int = 150):
        n = np.array([len(r) for r in rows])
        idx = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        used = np.flatnonzero(np.bincount(idx, minlength=size) >= least)
        to = np.full(size, -1)
        to[used] = np.arange(len(used))
        row = np.repeat(np.arange(len(rows)), n)
        col = to[idx]
        val = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)[col >= 0]
        row, col = row[col >= 0], col[col >= 0]
        self.mean, self.std = (dense.mean(0), dense.std(0) + 1e-6) if len(dense) else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
        x = (dense - self.mean) / self.std
        good = max(1.0, y.sum())
        bad = max(1.0, (1 - y).sum())
        weight = np.where(y == 1, len(y) / 2 / good, len(y) / 2 / bad)
        w, v, bias = np.zeros(len(used)), np.zeros(x.shape[1]), 0.0
        theta = np.zeros(len(used) + x.shape[1] + 1)
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        k = len(used)
        for t in range(1, steps + 1):
            w, v, bias = theta[:k], theta[k:-1], theta[-1]
            z = np.bincount(row, val * w[col], minlength=len(y)) + x @ v + bias
            r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / max(1, len(y))
            g = np.concatenate([np.bincount(col, val * r[row], minlength=k) + l2 * w, x.T @ r + l2 * v, [r.sum()]])
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            theta = theta - 0.3 / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        self.w = np.zeros(size)
        self.w[used] = theta[:k]
        self.v, self.bias = theta[k:-1], theta[-1]

    def score(self, idx: np.ndarray, start: np.ndarray, dense: np.ndarray) -> np.ndarray:
        n = np.diff(start)
        total = np.concatenate([[0.0], np.cumsum(self.w[idx])])
        return (total[start[1:]] - total[start[:-1]]) / np.sqrt(np.maximum(n, 1)) + ((dense - self.mean) / self.std) @ self.v + self.bias


def newton(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """A small logistic fit with intercept (last), a little regularized."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * w), -5, 5)
    return w


class Model:
    """Both views, their calibration and the combination."""

    def __init__(self, rows: dict, l2: float):
        order = np.lexsort((rows["pseudo"], rows["id"]))
        take = lambda k: [rows[k][i] for i in order]
        y, own, for_view = np.array(take("y"), float), np.array(take("pseudo")) == "", np.array(take("pseudo"))
        held = own & np.array(take("held"))
        w, shape, m = take("words"), np.array(take("shape"), float).reshape(len(y), -1), take("meta")
        self.share = float(y[own].mean()) if own.any() else 1.0
        fit = lambda view, rows, dense, size, least: Logistic([np.asarray(rows[i], np.int64) for i in np.flatnonzero(view)], dense[view], y[view], size, least, l2)
        self.text = fit(~held & (own | (for_view == "text")), w, shape, WORDS, 4)
        self.meta = fit(~held & (own | (for_view == "meta")), m, np.zeros((len(y), 0)), META, 2)
        test = held if held.sum() >= 20 else own
        pick = lambda rows: ([np.asarray(rows[i], np.int64) for i in np.flatnonzero(test)])
        zt, zm = self.scores(pick(w), shape[test], pick(m))
        self.ct, self.cm = newton(zt[:, None], y[test]), newton(zm[:, None], y[test])
        self.both = newton(np.c_[zt * self.ct[0] + self.ct[1], zm * self.cm[0] + self.cm[1]], y[test])

    def scores(self, w, shape, m):
        start = lambda rows: np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        cat = lambda rows: np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        return self.text.score(cat(w), start(w), shape), self.meta.score(cat(m), start(m), np.zeros((len(m), 0)))

    def apply(self, batch: pa.RecordBatch, text: str, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p of the text view, of the metadata view and of both."""
        zt = np.zeros(batch.num_rows)
        for a, b, idx, start, shape in text_view(batch.column(batch.schema.get_field_index(text))):
            zt[a:b] = self.text.score(idx, start, shape)
        m = meta_view(batch, names)
        zm = self.meta.score(m.ravel(), np.arange(batch.num_rows + 1) * m.shape[1], np.zeros((batch.num_rows, 0)))
        zt, zm = zt * self.ct[0] + self.ct[1], zm * self.cm[0] + self.cm[1]
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p(zt), p(zm), p(zt * self.both[0] + zm * self.both[1] + self.both[2])


FEATURES = "id long, y int, held boolean, pseudo string, words array<int>, shape array<double>, meta array<int>"


def _features(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, names: Sequence[str]) -> DataFrame:
    """Of the chosen (id, y, held, pseudo), a bounded table."""
    mine = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{n}`").alias(f"__m{j}") for j, n in enumerate(names)])
    rows = mine.join(F.broadcast(chosen), F.col("__id") == F.col("id")).drop("__id")
    tags = [f"__m{j}" for j in range(len(names))]

    def make(batches):
        for batch in batches:
            get = lambda n, batch=batch: batch.column(batch.schema.get_field_index(n))
            m, w, shapes = meta_view(batch, tags), [], []
            for a, b, idx, start, shape in text_view(get("__text")):
                w += [idx[start[i] : start[i + 1]].astype(np.int32) for i in range(b - a)]
                shapes += list(shape)
            cols = [get("id"), get("y"), get("held"), get("pseudo"), pa.array(w, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64())), pa.array(list(m.astype(np.int32)), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "y", "held", "pseudo", "words", "shape", "meta"])

    return rows.mapInArrow(tidy(make), FEATURES)


def _fit(rows: DataFrame, l2: float) -> Model:
    """In one task, over the bounded training rows."""

    def fit(batches):
        got = {k: [] for k in ("id", "y", "held", "pseudo", "words", "shape", "meta")}
        for batch in batches:
            for k in got:
                column = batch.column(batch.schema.get_field_index(k))
                got[k] += [np.asarray(x.values) for x in column] if k in ("words", "shape", "meta") else column.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(got, l2))], pa.binary())], names=["model"])

    return pickle.loads(rows.coalesce(1).mapInArrow(tidy(fit), "model binary").first()[0])


def train(docs: DataFrame, labels: DataFrame, meta_cols: Sequence[str] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, fit_rows: int = 20_000, exchange: int = 1_000, sure: float = 0.98, l2: float = 1e-6) -> Model | None:
    """The co-trained model; None without usable labels. Labels: (id, quality, toxic), good if quality is 1 and toxic 0."""
    scratch = Scratch(docs.sparkSession, "quality")
    names = [c for c in meta_cols if c in docs.columns and c not in (id_col, text_col)]
    known = labels.where(f"`{id_col}` is not null and quality is not null").groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).cast("int").alias("y"))
    known = scratch.save(known, "known")
    chosen = scratch.save(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("id", "y", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).alias("held"), F.lit("").alias("pseudo")), "chosen")
    rows = scratch.save(_features(docs, chosen, id_col, text_col, names).dropDuplicates(["id"]), "rows")
    if not rows.limit(1).count():
        return None
    model = _fit(rows, l2)
    more, used = None, None
    for turn in range(rounds):
        p = score(docs, model, names, id_col, text_col).where("doc_id is not null").join(known.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
        p = p if used is None else p.join(F.broadcast(used), "doc_id", "left_anti")
        views = F.array(*[F.struct(F.lit(to).alias("pseudo"), F.col(frm).alias("p")) for frm, to in (("p_text", "meta"), ("p_meta", "text"))])
        sure_of = p.select("doc_id", F.explode(views).alias("v")).select("doc_id", "v.*").where((F.col("p") >= sure) | (F.col("p") <= 1 - sure))
        # a bounded choice by hash, of each view and class: smallest hashes in every partition, then of these
        sure_of = scratch.save(sure_of.select(F.col("doc_id").alias("id"), (F.col("p") > 0.5).cast("int").alias("y"), F.lit(False).alias("held"), "pseudo"), "sure")
        parts = [sure_of.where((F.col("pseudo") == to) & (F.col("y") == y)).orderBy(F.xxhash64("id", F.lit(turn)), "id").limit(exchange) for to in ("text", "meta") for y in (0, 1)]
        picked = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
        picked = scratch.save(picked, "picked")
        got = scratch.save(_features(docs, picked, id_col, text_col, names).dropDuplicates(["id", "pseudo"]), "pseudo")
        more = got if more is None else more.union(got)
        ids = picked.select(F.col("id").alias("doc_id")).distinct()
        used = ids if used is None else used.union(ids).distinct()
        model = _fit(rows.union(more), l2)
    return model


def score(docs: DataFrame, model: Model, names: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_text, p_meta, score) of every row; no shuffle."""
    mine = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{n}`").alias(f"__m{j}") for j, n in enumerate(names)])
    tags = [f"__m{j}" for j in range(len(names))]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, held.value.apply(batch, "__text", tags))], names=["doc_id", "p_text", "p_meta", "score"])

    return mine.mapInArrow(tidy(run), "doc_id long, p_text double, p_meta double, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, meta_cols: Sequence[str] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **fit) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every row of ``docs``.

    A null or empty text counts as one without words; null metadata are a value of their own; rows with a null id are
    scored like others; repeated rows each get the same score. Without usable labels every score is 1. An empty table
    gives an empty result. Columns other than those named are not read.
    """
    names = [c for c in meta_cols if c in docs.columns and c not in (id_col, text_col)]
    model = train(docs, labels, meta_cols, id_col, text_col, **fit)
    if model is None:
        one = F.lit(1.0)
        return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), one.alias("p_text"), one.alias("p_meta"), one.alias("score"), F.lit(True).alias("keep"))
    return score(docs, model, names, id_col, text_col).withColumn("keep", F.col("score") >= threshold)


def accepted(docs: DataFrame, labels: DataFrame, meta_cols: Sequence[str] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **fit) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; rows and columns are else as they were.

    Nulls, repeated rows, very long texts and clashing names are as in ``quality_scores``. Without usable labels all rows
    stay; an empty table gives an empty one.
    """
    names = [c for c in meta_cols if c in docs.columns and c not in (id_col, text_col)]
    model = train(docs, labels, meta_cols, id_col, text_col, **fit)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.apply(batch, text_col, names)[2] >= threshold))

    return docs.mapInArrow(tidy(run), T.StructType(docs.schema.fields))
