"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a hash of its code point. A run of three letters is bound into
one vector: the first letter's permuted twice (rotated by two places), times the second's permuted once, times the
third's. A text is the sum of its runs' vectors, a language's prototype the sum of its texts'. A text gets the language
whose prototype has the largest cosine with it.

As +1 and -1 are bits, binding is an exclusive or of packed words; the sum over a piece of texts is one product of a
matrix of counts with a matrix of run vectors, in blocks of a bounded size. Sums are of whole numbers and exact, so they
don't depend on how the rows are dealt out.

Letters are code points that Unicode calls letters, lower-cased; all else separates words. Runs are centred on a letter:
beside it stands the next letter or the edge of the word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import U, mix, texts, tidy

#: Dimensions of a vector, a multiple of 64.
DIM = 1024
#: Bytes and texts of a piece, and runs whose vectors are made at a time.
PIECE, TEXTS, RUNS = 1 << 19, 256, 4096
#: Prototypes that a pass over the texts compares them with; where there are more languages, there are more passes.
LANGUAGES = 1024
#: The prediction for texts without a letter.
NONE = "und"


@functools.cache
def folded() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the bytes at which they begin."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    out = buf[at].astype(np.int64)
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        held = np.concatenate([buf, np.zeros(3, np.uint8)])
        lead, at_wide = out[wide], at[wide]
        tail = [held[at_wide + i].astype(np.int64) & 0x3F for i in (1, 2, 3)]
        two, three = (lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        out[wide] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    return out, at


def _pieces(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end, first byte, end): texts together up to a piece's size; a longer one in parts that end between code points."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(a + TEXTS, max(a + 1, int(np.searchsorted(off, off[a] + PIECE, "right")) - 1))
        x = int(off[a])
        while off[b] - x > PIECE and b == a + 1:
            y = x + PIECE
            while y > x + 1 and (buf[y] & 0xC0) == 0x80:
                y -= 1
            yield a, b, x, y
            x = y
        yield a, b, x, int(off[b])
        a = b


def _around(buf: np.ndarray, low: int, high: int, x: int, y: int) -> tuple[int, int]:
    """[x, y) with one code point more on either side, within [low, high)."""
    before, after = x, y
    if x > low:
        before = x - 1
        while before > low and (buf[before] & 0xC0) == 0x80:
            before -= 1
    if y < high:
        after = y + 1
        while after < high and (buf[after] & 0xC0) == 0x80:
            after += 1
    return before, after


def runs(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: first text, end, the alphabet, the runs as places in it [run, 3], and for each letter (text, run)."""
    for a, b, x, y in _pieces(buf, off):
        before, after = _around(buf, int(off[a]), int(off[b]), x, y)
        points, at = code_points(buf[before:after])
        letter = folded()[points]
        first = np.searchsorted(at, off[a:b] - before)  # of each text; an edge is put before it
        s = np.concatenate([np.insert(letter, first, 0), np.zeros(1, np.uint32)])
        place = np.concatenate([np.insert(at + before, first, -1), [-1]])
        centre = np.flatnonzero((s != 0) & (place >= x) & (place < y))
        text = np.searchsorted(off[a : b + 1], place[centre], "right") - 1
        mark = np.zeros(0x110000, bool)
        mark[s] = mark[0] = True
        alphabet = np.flatnonzero(mark)
        to = np.zeros(0x110000, np.int64)
        to[alphabet] = np.arange(len(alphabet))
        k, r = len(alphabet), to[s]
        key = (r[centre - 1] * k + r[centre]) * k + r[centre + 1]
        if k**3 <= 1 << 23:
            seen = np.zeros(k**3, bool)
            seen[key] = True
            known = np.flatnonzero(seen)
            rank = np.empty(k**3, np.int64)
            rank[known] = np.arange(len(known))
            run = rank[key]
        else:
            known, run = np.unique(key, return_inverse=True)
        yield a, b, alphabet, np.stack([known // (k * k), known // k % k, known % k], axis=1), np.stack([text, run])


def letter_bits(alphabet: np.ndarray, dim: int = DIM) -> list[np.ndarray]:
    """The letters' vectors as packed bits, permuted not at all, once and twice."""
    with np.errstate(over="ignore"):
        seed = (alphabet.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        words = mix(mix(seed)[:, None] + np.arange(dim // 64, dtype=U) * U(0xD1342543DE82EF95))
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return [np.packbits(np.roll(bits, i, axis=1), axis=1) for i in range(3)]


def bundled(rows: int, alphabet: np.ndarray, known: np.ndarray, row: np.ndarray, run: np.ndarray, dim: int = DIM) -> np.ndarray:
    """[row, dimension]: the sum of the vectors of each row's runs."""
    out = np.zeros((rows, dim))
    bits = letter_bits(alphabet, dim)
    for v in range(0, len(known), RUNS):
        block = known[v : v + RUNS]
        vectors = 1 - 2 * np.unpackbits(bits[2][block[:, 0]] ^ bits[1][block[:, 1]] ^ bits[0][block[:, 2]], axis=1).astype(np.float32)
        here = (run >= v) & (run < v + RUNS) if len(known) > RUNS else slice(None)
        counts = np.bincount(row[here] * len(block) + run[here] - v, minlength=rows * len(block)).reshape(rows, len(block))
        out += counts.astype(np.float32) @ vectors  # whole numbers under 2**24: exact
    return out


def vectors(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text and its number of letters."""
    buf, off = texts(column)
    out, letters = np.zeros((len(column), dim)), np.zeros(len(column), np.int64)
    for a, b, alphabet, known, (text, run) in runs(buf, off):
        out[a:b] += bundled(b - a, alphabet, known, text, run, dim)
        letters[a:b] += np.bincount(text, minlength=b - a)
    return out, letters


def _summed(dim: int):
    """Each language's sum over the texts of a task; (lang, place, value) rows."""

    def task(batches):
        total: dict[str, np.ndarray] = {}

        def told():
            for lang, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], names=["lang", "place", "value"])
            total.clear()

        for batch in batches:
            code = batch.column(1).dictionary_encode()
            names, which = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            buf, off = texts(batch.column(0))
            for a, b, alphabet, known, (text, run) in runs(buf, off):
                here, row = np.unique(which[a:b], return_inverse=True)
                for lang, v in zip(here, bundled(len(here), alphabet, known, row[text], run, dim), strict=True):
                    total[names[lang]] = total[names[lang]] + v if names[lang] in total else v
            if len(total) > LANGUAGES:
                yield from told()
        yield from told()

    return tidy(task)


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """(lang, v): the sum of the vectors of each language's texts. A null text or language takes no part; a language without a letter has no row."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_summed(dim), "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda e: e["value"]).alias("v")).where("exists(v, e -> e <> 0)")


def _compared(names: list[str], held, keep_text: bool):
    fields = ["text"] if keep_text else []

    def run(batches):
        unit = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                v, letters = vectors(batch.column("text"), unit.shape[1])
                length = np.sqrt((v * v).sum(axis=1))
                cosine = np.divide(v @ unit.T, length[:, None], out=np.zeros((len(v), len(unit))), where=length[:, None] > 0)
                best = np.argmax(cosine, axis=1)
                score = cosine[np.arange(len(v)), best]
                before = batch.column("score").to_numpy(zero_copy_only=False)
                better = (letters > 0) & ~(before >= score)  # the first pass meets no score
                label = [names[i] if is_so else old for i, is_so, old in zip(best, better, batch.column("lang_pred").to_pylist(), strict=True)]
                cols = [*(batch.column(c) for c in ("doc_id", "held_out", *fields)), pa.array(label, pa.string()), pa.array(np.where(better, score, before), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", *fields, "lang_pred", "score"])

    return tidy(run)


def identified(docs: DataFrame, learned: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of each text among those of ``prototypes``, and the cosine (0 if negative).

    Only the text is looked at. A null text, one without a letter, and any text where nothing was learned get ``und`` and
    score 0. Ties go to the language that is first by code point. Every row gives one row, repeated ones and those with a
    null id too; texts of any length are read whole, in pieces; an empty table gives none. ``held_out`` is carried along
    (null if not given). Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    learned = Scratch(spark, "language").save(learned.select("lang", "v"), "prototypes")
    slices: list[tuple[list[str], np.ndarray]] = []
    names, held = [], []
    for r in learned.orderBy("lang").toLocalIterator():
        v = np.array(r["v"])
        names.append(r["lang"])
        held.append(v / np.sqrt((v * v).sum()))
        if len(names) == LANGUAGES:
            slices.append((names, spark.sparkContext.broadcast(np.array(held))))
            names, held = [], []
    if names:
        slices.append((names, spark.sparkContext.broadcast(np.array(held))))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.lit(None) if held_out is None else held_out).cast("boolean").alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    for i, (labels, unit) in enumerate(slices):
        more = i + 1 < len(slices)
        rows = rows.mapInArrow(_compared(labels, unit, more), f"doc_id long, held_out boolean, {'text string, ' if more else ''}lang_pred string, score double")
    return rows.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(NONE)).alias("lang_pred"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("score"))


def languages(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """As ``identified``, learned from those rows of ``docs`` whose crc32 of the id (as text) is no multiple of ``folds``; the others are held out.

    A row with a null id is held out; one with a null language is not learned from. Where no row can be learned from,
    all are ``und``.
    """
    held_out = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == 0, F.lit(True))
    return identified(docs, prototypes(docs.where(~held_out), text_col, lang_col, dim), held_out, id_col, text_col)
