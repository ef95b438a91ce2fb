"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes fall into buckets by their first q bytes. A bucket is refined by the identifiers of the buckets that its suffixes
are in at later offsets. An identifier is a fingerprint of those that it is made of, so it is the same in every task and needs no global
order. A bucket of one document is done and drops out, as no string of it can stand in another.

A match of ``length`` bytes holds the same local minimum of the identifiers of its q-byte strings in either document. So
only suffixes at such minima enter (one in about thirteen), by these steps, each over what the one before has left:

1. their q-byte buckets that two documents share
2. the bucket of all windows for which the suffix is the minimum; documents after the first of a bucket are settled, and
   that first one stands for them from here on
3. of suffixes that are not settled, the buckets of q bytes with 13 more on either side: a match has one of these
4. the windows of ``length`` bytes themselves

A window counts as repeated if a smaller doc_id has it too. Identifiers have 64 bits: two different strings among n
windows of the last step meet by chance about n * n / 2**65 times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import shared_keys
from .scratch import Scratch
from .text import BYTE, INVERSE, SPAN, U, mix, pieces, powers, texts, tidy

A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
Q = 24
#: Text in a bucket of documents.
BUCKET_BYTES = 32 << 20


def identifiers(buf: np.ndarray, q: int = Q) -> np.ndarray:
    """The bucket of the q bytes that begin at each place, by running sums over so much text as a processor's cache holds."""
    n = max(0, len(buf) - q + 1)
    out = np.empty(n, U)
    for a in range(0, n, SPAN):
        b = min(n, a + SPAN)
        total = np.zeros(b - a + q, U)
        np.cumsum(BYTE[buf[a : b + q - 1]] * powers(b - a + q)[: b - a + q - 1], out=total[1:])
        out[a:b] = mix((total[q:] - total[:-q]) * powers(b - a, INVERSE)[: b - a])
    return out


def slide(x: np.ndarray, w: int, take) -> np.ndarray:
    """The least (or largest) of each w neighbours."""
    n = 1
    while 2 * n <= w:
        x = take(x[:-n], x[n:])
        n *= 2
    return take(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


class Piece:
    """Documents one after another, their buckets and minima."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int):
        self.off, self.length, self.w = off, length, length - Q + 1
        self.h = identifiers(buf)
        self.least = slide(self.h, self.w, np.minimum) if len(self.h) >= self.w else np.zeros(0, U)

    def refined(self, at: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """Identifiers of the strings from ``at`` to ``end``, of at most ``most`` bytes: of the q-byte buckets at each q-th later offset, and at the last."""
        key = mix(self.h[at] + (end - at).astype(U) * C)
        for step in range(Q, most, Q):
            key = mix(key * A + self.h[np.minimum(at + step, end - Q)] * B)
        return key

    def minima(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and documents of the minima of all windows that lie in one document."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        most = slide(np.concatenate([np.zeros(self.w - 1, U), self.least, np.zeros(self.w - 1, U)]), self.w, np.maximum)
        at = np.flatnonzero(most[: len(self.h)] == self.h)
        doc = np.searchsorted(self.off, at, "right") - 1
        ok = (at + Q <= self.off[doc + 1]) & (self.off[doc + 1] - self.off[doc] >= self.length)
        return at[ok], doc[ok]

    def ranges(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of the document for which the place is the minimum; first above last if there is none."""
        lo, hi = at + 1, at - self.length
        for back in range(self.w):
            s = at - back
            ok = (s >= self.off[doc]) & (s + self.length <= self.off[doc + 1])
            ok[ok] = self.least[s[ok]] == self.h[at[ok]]
            lo, hi = np.where(ok, s, lo), np.maximum(hi, np.where(ok, s, hi))
        return lo, hi

    def inside(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places (each once) that are the minimum of some window, with their documents and the range of windows."""
        ok = at + Q <= self.off[doc + 1]
        at, first = np.unique(at[ok], return_index=True)
        doc = doc[ok][first]
        lo, hi = self.ranges(at, doc)
        ok = lo <= hi
        return at[ok], doc[ok], lo[ok], hi[ok]


def deduplicated(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of each document.

    Every byte that a string of ``length`` bytes covers is removed, if the string also begins in a document of a smaller
    id; strings are those of the input. Texts are UTF-8 bytes; a null text is empty. Rows with a null id take no part.
    Rows of one id are one document, whose text is the least of theirs. An empty table gives an empty result. Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    assert length >= Q + 26, "the steps are made for strings of 50 bytes or more"
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    density = 2.0 / (length - Q + 2)
    # the texts move once, into buckets by id; each step then joins its places to them where they are
    by_id = lambda df: df.groupBy("id").agg(F.min("text").alias("text"))
    with scratch.bucketed(rows, "id", n_bytes / BUCKET_BYTES, by_id) as docs:
        done = scratch.save(_cut(scratch, docs, length, n_bytes, with_text), "done")
    return done


def _cut(scratch: Scratch, docs: DataFrame, length: int, n_bytes: int, with_text: bool) -> DataFrame:
    shift = (length - Q + 1).bit_length()  # of how far a minimum's windows begin before it

    def at_minima(batch):
        for ids, own, begin in _placed(batch):
            p = Piece(own, begin, length)
            at, doc = p.minima()
            yield mix(p.h[at]), ids[doc], at - begin[doc]

    def places(df: DataFrame, name: str) -> DataFrame:
        return scratch.save(df.groupBy(F.col("owner").alias("id")).agg(F.collect_list("place").alias(name)), name)

    def later(met: DataFrame) -> DataFrame:
        """Those that a smaller owner has too. The least owners are a table, so Spark may split a key with many owners."""
        first = scratch.save(met.groupBy("key").agg(F.min("owner").alias("first")), "first")
        return met.join(first, "key").where("owner > first").select("owner", "place")

    cands = places(shared_keys(docs, at_minima, n_bytes * 2.0 / (length - Q + 2)).select("owner", "place"), "places")
    n_cand = cands.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]

    def around(batch):
        for ids, own, begin, (place, doc) in _placed(batch):
            p = Piece(own, begin, length)
            at, doc, lo, hi = p.inside(place + begin[doc], doc)
            if len(at):
                key = mix(p.refined(lo, hi + length, 2 * length - Q) + (at - lo).astype(U) * B)
                yield key, ids[doc], ((at - begin[doc] << shift) + at - lo << shift) + at - hi

    met = scratch.save(shared_keys(docs.join(cands, "id"), around, n_cand, exact=True), "met")
    settled = places(later(met), "settled")

    def either_side(batch):
        for ids, own, begin, (place, doc), (done, of) in _placed(batch):
            left = ~np.isin(place + begin[doc], (done >> 2 * shift) + begin[of])
            place, doc = place[left], doc[left]
            if not len(place):
                continue
            p = Piece(own, begin, length)
            at, doc, lo, hi = p.inside(place + begin[doc], doc)
            place = (((at - begin[doc] << shift) + at - lo << shift) + at - hi) * 2
            ok = at - 13 >= begin[doc]
            yield mix(p.refined(at[ok] - 13, at[ok] + Q, Q + 13) + A), ids[doc[ok]], place[ok]
            ok = at + Q + 13 <= begin[doc + 1]
            yield mix(p.refined(at[ok], at[ok] + Q + 13, Q + 13) + B), ids[doc[ok]], place[ok] + 1

    open_ = places(shared_keys(docs.join(cands, "id").join(settled, "id", "left"), either_side, 1.5 * n_cand).select("owner", "place"), "open")
    n_open = open_.agg(F.coalesce(F.sum(F.size("open")), F.lit(0))).first()[0]

    def windows(batch):
        for ids, own, begin, (place, doc) in _placed(batch):
            if not len(place):
                continue
            p = Piece(own, begin, length)
            side, place = place % 2, place // 2
            at = (place >> 2 * shift) + begin[doc]
            lo, hi = at - (place >> shift & (1 << shift) - 1), at - (place & (1 << shift) - 1)
            lo, hi = np.where(side == 1, np.maximum(lo, at - 13), lo), np.where(side == 0, np.minimum(hi, at - 13), hi)
            n = np.maximum(0, hi - lo + 1)
            s = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, where = np.unique(s, return_index=True)
            owner = np.repeat(doc, n)[where]
            if len(s):
                yield p.refined(s, s + length, length), ids[owner], s - begin[owner]

    hits = scratch.save(shared_keys(docs.join(open_, "id"), windows, 5.0 * n_open, exact=True), "hits")
    again = places(later(hits), "hit")

    def finish(batches):
        for batch in batches:
            for ids, own, begin, (place, doc), (hit, of) in _placed(batch):
                cover = np.zeros(len(own) + 1, np.int32)
                at = (place >> 2 * shift) + begin[doc]
                np.add.at(cover, at - (place >> shift & (1 << shift) - 1), 1)
                np.add.at(cover, at - (place & (1 << shift) - 1) + length, -1)
                np.add.at(cover, hit + begin[of], 1)
                np.add.at(cover, hit + begin[of] + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                before = np.zeros(len(own), bool)
                before[1:] = gone[:-1]
                before[begin[:-1][begin[:-1] < len(own)]] = False  # a run ends with its document
                removed, spans = (np.concatenate([[0], np.cumsum(x)])[begin] for x in (gone, gone & ~before))
                kept, cut = own[~gone], begin - removed
                held = [kept[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (np.diff(begin), np.diff(removed), np.diff(spans))), pa.array([hashlib.sha256(x).hexdigest() for x in held], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.binary())] if with_text else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return docs.join(settled, "id", "left").join(again, "id", "left").mapInArrow(tidy(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _placed(batch: pa.RecordBatch):
    """ids, bytes, starts, and for each column of lists the places with their documents, piece by piece."""
    ids = batch.column(0).to_numpy()
    buf, off = texts(batch.column(1))
    for a, b, own, begin in pieces(buf, off, 1 << 19):
        lists = []
        for c in range(2, batch.num_columns):
            part = batch.column(c).slice(a, b - a)
            n = np.where(part.is_valid().to_numpy(zero_copy_only=False), pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy(zero_copy_only=False), 0)
            lists.append((part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(b - a), n)))
        yield ids[a:b], own, begin, *lists
