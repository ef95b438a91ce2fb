"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask laid over a run of words; words under a 0 are ignored, so a substituted word there does not hide
the overlap. The four masks together hit every window of 13 words with at most two substitutions (a test enumerates
them). Hits are hashes that a document and a benchmark item share; around each hit the words are compared along its
diagonal, and a document is contaminated by an item if some window of 13 words there has 11 or more equal ones.

The items' seeds are broadcast in slices of bounded size, each slice a pass over the documents, which are never shuffled.
A benchmark of more than JOIN_WORDS words is joined by hash instead: both sides' seeds, each with the words around it, meet
by seed, and a broadcast filter of fixed size keeps back most of the documents' seeds that no item has. Both ways give
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PUNCT, U, mix, pieces, texts, tidy, words

MASKS = ("11110111", "1110100111", "1111111", "11101111")
WINDOW, EQUAL = 13, 11
#: Of items shorter than the window: from SHORT words on one may be substituted, and a run of these four is left then.
SHORT, RUN = 8, "1111"
#: Items of fewer words say too little to be looked for, unless asked.
LEAST = 5
#: Benchmark words of a slice: its seeds take about 24 bytes for each word and mask.
SLICE_WORDS = 250_000
#: Pairs of equal seeds that are compared at a time.
PAIRS = 50_000
#: Estimated benchmark words (a quarter of the characters) beyond which seeds are joined; up to here there are at most 17 slices.
JOIN_WORDS = 4_000_000
#: Bits of the filter of benchmark seeds (32 MB), at any number of seeds.
FILTER_BITS = 1 << 28
#: Places of a text whose seeds are laid out at a time.
PLACES = 20_000
SEEDS = "seed long, mask int, key binary, at int, low int, high int, around binary"
FOUND = "doc_key binary, item_key binary, doc_at int, item_at int, n_words int, n_equal int"
HITS = "doc_id long, item_id long, doc_at int, item_at int, n_words int, n_equal int"


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = max(0, len(h) - len(mask) + 1)
    out = np.full(n, U(hash_of(mask)))
    for j, c in enumerate(mask):
        if c == "1":
            out = mix(out ^ h[j : j + n])
    return out


def hash_of(mask: str) -> int:
    return int(mask, 2) * 2 + 1


def needed(size: int) -> tuple[int, int]:
    """Words of an item's window, and how many of them must be equal."""
    return (WINDOW, EQUAL) if size >= WINDOW else (size, size - 1 if size >= SHORT else size)


def masks_of(size: int) -> tuple[str, ...]:
    return MASKS if size >= WINDOW else (RUN,) if size >= SHORT else ("1" * size,)


class Slice:
    """Benchmark items of a slice with their seeds in sorted order."""

    def __init__(self, ids: list[int], contents: list[str], least: int = LEAST):
        column = pa.array(contents, pa.string())
        buf, off = texts(column)
        self.words, first = words(buf, off, PUNCT)
        self.ids, self.first = np.array(ids, np.int64), first
        self.size, self.equal = np.array([needed(int(n)) for n in np.diff(first)], np.int64).reshape(-1, 2).T
        by_mask: dict[str, list[int]] = {}
        for i, n in enumerate(np.diff(first)):
            for mask in masks_of(int(n)) if n >= max(1, least) else ():
                by_mask.setdefault(mask, []).append(i)
        self.masks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.maybe = np.zeros(1 << 22, bool)
        for mask, items in by_mask.items():
            seeds = [_seeds(self.words[first[i] : first[i + 1]], mask) for i in items]
            item = np.repeat(items, [len(x) for x in seeds])
            place = np.concatenate([np.arange(len(x)) for x in seeds]) + first[item]
            seeds = np.concatenate(seeds)
            order = np.argsort(seeds, kind="stable")
            self.masks[mask] = seeds[order], item[order], place[order]
            self.maybe[(seeds >> U(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(document, item, place in either, words, equal words) of the best window of each pair, for documents one after another.

        Pairs of equal seeds are taken in the order of the documents' words, so many at a time, and only the windows
        around a hit are compared; an item that a document holds word by word is not looked for again in it.
        """
        best: dict[tuple[int, int], tuple] = {}
        for mask, (seeds, item_of, place_of) in self.masks.items():
            s = _seeds(h, mask)
            at = np.flatnonzero(self.maybe[(s >> U(42)).astype(np.int64)])
            lo, hi = np.searchsorted(seeds, s[at]), np.searchsorted(seeds, s[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            ok = (hi > lo) & (at + len(mask) <= first[doc + 1])
            at, lo, hi, doc = at[ok], lo[ok], hi[ok], doc[ok]
            upto = np.cumsum(hi - lo)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
                n = hi[a:b] - lo[a:b]
                each = np.repeat(lo[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self._around(h, first, np.repeat(at[a:b], n), np.repeat(doc[a:b], n), item_of[each], place_of[each], len(mask), best)
                a = b
                whole = np.array([d * len(self.ids) + i for (d, i), found in best.items() if -found[0] == self.size[i]], np.int64)
                if len(whole) and a < len(at):  # what is left of each place's items
                    same = np.array([np.isin(doc[a:] * len(self.ids) + item_of[np.minimum(lo[a:] + j, len(item_of) - 1)], whole) | (lo[a:] + j >= hi[a:]) for j in range(int(min(64, (hi[a:] - lo[a:]).max())))]).all(0)
                    keep = ~(same & (hi[a:] - lo[a:] <= 64))
                    at, lo, hi, doc = at[a:][keep], lo[a:][keep], hi[a:][keep], doc[a:][keep]
                    upto, a = np.cumsum(hi - lo), 0
        for (d, i), (equal, at, place) in sorted(best.items()):
            yield int(d), int(self.ids[i]), int(at - first[d]), int(place - self.first[i]), int(self.size[i]), int(-equal)

    def _around(self, h, first, at, doc, item, place, length: int, best: dict) -> None:
        """Compare the windows that hold a seed of ``length`` words at these places of documents and items."""
        for size in np.unique(self.size[item]):
            own = self.size[item] == size
            a, d, i, q = at[own], doc[own], item[own], place[own]
            span = np.arange(length - size, size)
            x, y = a[:, None] + span, q[:, None] + span
            inside = (x >= first[d][:, None]) & (x < first[d + 1][:, None]) & (y >= self.first[i][:, None]) & (y < self.first[i + 1][:, None])
            same = np.zeros((len(a), len(span) + 1), np.int64)
            np.cumsum(inside & (h[np.clip(x, 0, len(h) - 1)] == self.words[np.clip(y, 0, len(self.words) - 1)]), axis=1, out=same[:, 1:])
            whole = np.zeros((len(a), len(span) + 1), np.int64)
            np.cumsum(inside, axis=1, out=whole[:, 1:])
            count = np.where(whole[:, size:] - whole[:, :-size] == size, same[:, size:] - same[:, :-size], -1)
            k = np.argmax(count, axis=1)
            found = count[np.arange(len(a)), k]
            for j in np.flatnonzero(found >= self.equal[i]):
                got = (-int(found[j]), int(a[j] + span[k[j]]), int(q[j] + span[k[j]]))
                key = (int(d[j]), int(i[j]))
                if got < best.get(key, (1,)):
                    best[key] = got


def _items(bench: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(i, t) of the items that have an id and a text, and about how many words these are."""
    rows = bench.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return rows, rows.agg(F.coalesce(F.sum(F.length("t") / 4), F.lit(0))).first()[0]


def _slices(rows: DataFrame, total: float, least: int) -> Iterator[Slice]:
    """Bounded parts of the benchmark, one after another; an item is never cut."""
    n = int(total // SLICE_WORDS) + 1
    for k in range(n):
        got = sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect())
        if got:
            yield Slice([r[0] for r in got], [r[1] for r in got], least)


def _in_batch(batch_text: pa.Array, part: Slice) -> Iterator[tuple[int, ...]]:
    buf, off = texts(batch_text)
    for a, _, own, begin in pieces(buf, off):
        for d, *rest in part.hits(*words(own, begin, PUNCT)):
            yield a + d, *rest


def _all_masks(least: int) -> list[str]:
    return [*dict.fromkeys(m for n in range(max(1, least), WINDOW + 1) for m in masks_of(n))]


def _probes(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each seed in the filter."""
    return (seeds % U(bits)).astype(np.int64), (mix(seeds ^ U(0x5DEECE66D)) % U(bits)).astype(np.int64)


def _laid_out(column: pa.Array, keys: list[bytes], masks: list[str], least: int, items: bool, held: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Seeds of texts, each with the words of all windows that hold it. Of items the masks of their size, of documents all that may be in the filter.

    Places of a document with the same words around are laid out once, the first one, within so many places.
    """
    buf, off = texts(column)
    for begin, _, own, starts in pieces(buf, off):
        h, first = words(own, starts, PUNCT)
        sizes = np.diff(first)
        for number, mask in enumerate(masks):
            seeds = _seeds(h, mask)
            ok = np.ones(len(seeds), bool)
            if held is not None:
                for place in _probes(seeds, len(held) * 64):
                    ok &= (held[place >> 6] >> (place & 63).astype(U)) & U(1) == 1
            at = np.flatnonzero(ok)
            doc = np.searchsorted(first, at, "right") - 1
            fits = at + len(mask) <= first[doc + 1]
            if items:
                wanted = np.array([n >= max(1, least) and mask in masks_of(int(n)) for n in sizes], bool)
                fits &= wanted[doc] if len(doc) else fits
            at, doc = at[fits], doc[fits]
            span = np.arange(len(mask) - WINDOW, WINDOW)
            for i in range(0, len(at), PLACES):
                a, d = at[i : i + PLACES], doc[i : i + PLACES]
                low = np.maximum(first[d] - (a + span[0]), 0)
                high = np.minimum(first[d + 1] - (a + span[0]), len(span))
                place = np.arange(len(span))
                inside = (place >= low[:, None]) & (place < high[:, None])
                around = np.where(inside, h[np.clip(a[:, None] + span, 0, len(h) - 1)], U(0))
                whole = np.ascontiguousarray(np.column_stack([d.astype(U), low.astype(U), high.astype(U), around]))
                once = np.sort(np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_index=True)[1])
                a, d, around = a[once], d[once], np.ascontiguousarray(around[once].astype("<u8"))
                ends = np.arange(len(a) + 1, dtype=np.int32) * (len(span) * 8)
                yield pa.RecordBatch.from_arrays([
                    pa.array(seeds[a].view(np.int64)), pa.array(np.full(len(a), number, np.int32)), pa.array([keys[begin + j] for j in d], pa.binary()),
                    pa.array((a - first[d]).astype(np.int32)), pa.array(low[once].astype(np.int32)), pa.array(high[once].astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(around)]),
                ], names=["seed", "mask", "key", "at", "low", "high", "around"])


def _compared(batch: pa.RecordBatch, masks: list[str]) -> pa.RecordBatch:
    """Of each pair of equal seeds the best window that holds them, if enough of its words are equal."""
    got = {n: np.asarray(batch.column(n)) for n in ("mask", "at", "low", "high", "item_at", "item_low", "item_high", "size")}
    rows, out = [], {n: [] for n in ("doc_at", "item_at", "n_words", "n_equal")}
    for number in np.unique(got["mask"]):
        length, width = len(masks[number]), 2 * WINDOW - len(masks[number])
        for size in np.unique(got["size"][got["mask"] == number]):
            at = np.flatnonzero((got["mask"] == number) & (got["size"] == size))
            x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), "<u8").reshape(len(at), width) for c in ("around", "item_around"))
            place = np.arange(width)
            inside = (place >= np.maximum(got["low"], got["item_low"])[at, None]) & (place < np.minimum(got["high"], got["item_high"])[at, None])
            side = WINDOW - size  # of shorter items the windows reach less far
            held = slice(side, width - side)
            same, whole = (np.pad(np.cumsum(v[:, held], axis=1), ((0, 0), (1, 0))) for v in (inside & (x == y), inside))
            count = np.where(whole[:, size:] - whole[:, :-size] == size, same[:, size:] - same[:, :-size], -1)
            k = np.argmax(count, axis=1)
            found = count[np.arange(len(at)), k]
            ok = found >= needed(int(size))[1]
            move = (length - size + k)[ok]
            rows.append(at[ok])
            for n, v in (("doc_at", got["at"][at][ok] + move), ("item_at", got["item_at"][at][ok] + move), ("n_words", np.full(ok.sum(), size)), ("n_equal", found[ok])):
                out[n].append(v)
    rows = pa.array(np.concatenate(rows) if rows else [], pa.int64())
    flat = [pa.array(np.concatenate(v).astype(np.int32) if v else [], pa.int32()) for v in out.values()]
    return pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("item_key").take(rows), *flat], names=["doc_key", "item_key", *out])


def _key(text: str):
    """Sixteen bytes that stand for a text; NULL for none."""
    return F.unhex(F.md5(F.col(text).cast("string")))


def _joined(docs: DataFrame, text_col: str, items: DataFrame, least: int, bits: int = FILTER_BITS) -> DataFrame:
    """FOUND: each text of ``docs`` with each text of ``items`` (i, t) that it holds, and the best window, by a join of seeds.

    Equal texts count as one here. A seed that very many documents share makes a large partition of the join, which
    adaptive execution splits; its items are those that have the seed, so that no more pairs are made than are compared.
    """
    spark, masks = docs.sparkSession, _all_masks(least)

    def seeds_of(rows: DataFrame, of_items: bool, held=None) -> DataFrame:
        def lay(batches):
            for batch in batches:
                yield from _laid_out(batch.column(1), batch.column(0).to_pylist(), masks, least, of_items, held and held.value)

        return rows.mapInArrow(tidy(lay), SEEDS)

    texts_of_items = items.select(_key("t").alias("k"), "t").dropDuplicates(["k"])
    asked = seeds_of(texts_of_items, True)

    def places(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_probes(np.asarray(batch.column(0)).view(U), bits)))
            word, start = np.unique(at >> 6, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), start).view(np.int64) if len(at) else [], pa.int64())], names=["word", "b"])

    set_bits = asked.select("seed").mapInArrow(places, "word long, b long").groupBy("word").agg(F.bit_or("b").alias("b")).toArrow()  # bits / 64 rows at most
    held = np.zeros(bits // 64, U)
    held[np.asarray(set_bits["word"], np.int64)] = np.asarray(set_bits["b"], np.int64).view(U)
    held = spark.sparkContext.broadcast(held)
    said = docs.where(F.col(f"`{text_col}`").isNotNull()).select(_key(f"`{text_col}`").alias("k"), F.col(f"`{text_col}`").cast("string"))

    def sized(batches):
        for batch in batches:
            first = words(*texts(batch.column(1)), PUNCT)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([needed(int(n))[0] for n in np.diff(first)], pa.int32())], names=["item_key", "size"])

    sizes = texts_of_items.mapInArrow(sized, "item_key binary, size int")
    asked = asked.withColumnsRenamed({"key": "item_key", "at": "item_at", "low": "item_low", "high": "item_high", "around": "item_around"}).join(sizes, "item_key")

    def compare(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                yield _compared(batch.slice(i, PAIRS), masks)

    pairs = seeds_of(said, False, held).join(asked, ["seed", "mask"]).drop("seed")
    best = F.min(F.struct((-F.col("n_equal")).alias("e"), "doc_at", "item_at", "n_words")).alias("b")
    found = pairs.mapInArrow(tidy(compare), FOUND).groupBy("doc_key", "item_key").agg(best)
    return found.select("doc_key", "item_key", "b.doc_at", "b.item_at", "b.n_words", (-F.col("b.e")).alias("n_equal"))


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, join_above: float = JOIN_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_at, item_at, n_words, n_equal): each document with each item that it holds, and the best window.

    Words are runs of ASCII letters and digits and of all other characters, A-Z in lower case. Of an item of 8 to 12
    words all but one must stand in the document in their places, of a shorter one all. Null or empty texts on either
    side, items of fewer than ``least`` words (``least=1`` looks for all) and rows with a null id on either side give no
    hit. The best window has the most equal words; ties go to the earliest in the document, then in the item. Documents
    and items repeated under one id each give theirs. Texts of any length are read whole, in bounded memory besides the
    text. An empty table gives none. Benchmarks of more than ``join_above`` words are joined by their seeds' hashes.
    """
    spark, out = docs.sparkSession, None
    items, total = _items(bench, item_col, item_text)
    if total > join_above:
        found = _joined(docs, text_col, items, least)
        found = found.join(items.select(F.col("i").alias("item_id"), _key("t").alias("item_key")), "item_key")
        own = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _key(f"`{text_col}`").alias("doc_key"))
        return own.join(found, "doc_key").select("doc_id", "item_id", "doc_at", "item_at", "n_words", "n_equal")
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    for part in _slices(items, total, least):
        held = spark.sparkContext.broadcast(part)

        def find(batches, held=held):
            for batch in batches:
                ids = np.asarray(batch.column(0))
                got = [(int(ids[d]), *rest) for d, *rest in _in_batch(batch.column(1), held.value)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], names=["doc_id", "item_id", "doc_at", "item_at", "n_words", "n_equal"])

        more = rows.mapInArrow(tidy(find), HITS)
        out = more if out is None else out.union(more)
    return spark.createDataFrame([], HITS) if out is None else out


def clean_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, join_above: float = JOIN_WORDS) -> DataFrame:
    """``docs`` without the contaminated rows; rows and columns are else as they were. No shuffle up to ``join_above`` benchmark words.

    Null and empty texts, and rows without an id, stay unless a text of theirs holds an item; ids are not read. An
    empty table, or an empty benchmark, gives ``docs`` back.
    """
    items, total = _items(bench, item_col, item_text)
    if total > join_above:
        gone = _joined(docs, text_col, items, least).select(F.col("doc_key").alias("__doc_key")).distinct()
        return docs.join(gone, _key(f"`{text_col}`") == F.col("__doc_key"), "left_anti")
    spark, schema = docs.sparkSession, T.StructType(docs.schema.fields)
    place = docs.columns.index(text_col)
    for part in _slices(items, total, least):
        held = spark.sparkContext.broadcast(part)

        def keep(batches, held=held):
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                ok[[d for d, *_ in _in_batch(batch.column(place), held.value)]] = False
                yield batch.filter(pa.array(ok))

        docs = docs.mapInArrow(tidy(keep), schema)
    return docs
