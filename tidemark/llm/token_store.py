"""Token ids in a binary store with constant-time access by document key.

The store is a folder of two Parquet tables, so that any file system that Spark can write will do:

``payload``  part, block, ids: the raw ids of a part as little-endian unsigned integers of ``width`` bytes (2 where the
             vocabulary allows it, else 4), cut into blocks of ``BLOCK`` ids, in the order of the documents' keys
``index``    part, width, first_id, n_ids, n_keys, low, high, levels, bits, fingerprints, starts: of each part

The index holds a minimal perfect hash of the part's keys: level by level, a key goes to a bit of the level's array; bits
that one key alone wants are set, and the other keys go on to the next level. A key's slot is the number of set bits
before its own. At the slot are the key's fingerprint, by which keys that were never stored are told (but one in 2**32),
and where its ids start in the part.

Parts are ranges of keys; keys repeat at most within a part and then stand in order, under one entry of the index that
spans them all.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import BYTE, INVERSE, SPAN, U, mix, pieces, powers, texts

BLOCK = 1 << 18
#: Units whose ids a worker remembers, and the longest (in bytes) that is worth it.
MEMO, MEMO_BYTES = 1_000_000, 40
#: Text that is encoded at a time.
STEP = 4 << 20
WRITTEN = "kind string, part int, block int, ids binary, width int, first_id long, n_ids long, n_keys long, low long, high long, levels binary, bits binary, fingerprints binary, starts binary"
#: Letters 1 (ASCII, and bytes of U+00C0 to U+027F), marks 2, white space 4, others 0.
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
KIND[[*b".,;:!?"]] = 2
KIND[[32, 10]] = 4
#: How byte-level vocabularies write each byte: printable Latin-1 as itself, the others in order from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Bytes that are white space, or that white space in UTF-8 begins with.
_OTHER = np.zeros(256, bool)
_OTHER[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_WHITE = re.compile(rb"[\x09\x0b-\x0d\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


class Encoder:
    """Ids of whole texts with the tokenizers library; units of text are encoded once and remembered by a 64-bit hash.

    The byte-level pre-tokenizer with its own pattern begins a new token at a single space before a visible character,
    and makes one of a single line feed between such characters. A text without other white space so has the ids of its
    units: line feeds, and words with the space before them. In a word of letters and marks only, it begins a new token
    wherever these two meet. Any other text is encoded whole, and so is every text if
    the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_unit = self._plain(json.loads(self.tokenizer.to_str())) and len(self.feed) == 1
        self._forget()

    @staticmethod
    def _plain(told: dict) -> bool:
        """Whether what the class says of units holds for a tokenizer."""
        pre, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
        whole = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told.get("added_tokens") or ())
        return whole and told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")

    def _forget(self) -> None:
        self.n, self.size = 0, 1 << 16
        self.key, self.index = np.zeros(self.size, U), np.full(self.size, -1, np.int32)
        self.at, self.count = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.kind), 0

    def _slots(self, key: np.ndarray, free: bool) -> np.ndarray:
        """Of each (distinct) key the slot where it is, or else -1; with ``free``, where it may be put."""
        slot = (key >> U(64 - self.size.bit_length() + 1)).astype(np.int64)
        out, left = np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(left):
            held = self.index[slot[left]] >= 0
            done = held & (self.key[slot[left]] == key[left])
            out[left[done]] = slot[left[done]]
            if free:
                empty = left[~held]
                self.index[slot[empty]] = empty  # one of those that want it stays
                won = empty[self.index[slot[empty]] == empty]
                self.key[slot[won]] = key[won]
                out[won] = slot[won]
                done |= out[left] >= 0
            else:
                done |= ~held
            left = left[~done]
            slot[left] = (slot[left] + 1) & (self.size - 1)
        return out

    def _put(self, key: np.ndarray, index: np.ndarray) -> None:
        if 2 * (self.n + len(key)) > self.size:
            had = self.index >= 0
            key, index = np.concatenate([self.key[had], key]), np.concatenate([self.index[had], index])
            while 2 * len(key) > self.size:
                self.size *= 2
            self.key, self.index = np.zeros(self.size, U), np.full(self.size, -1, np.int32)
        before = self.index.copy()
        slot = self._slots(key, True)
        self.index = before
        self.index[slot] = index

    def _pooled(self, ids: list[int], count: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Put ids at the end of the pool, so many for each unit; the units' places and counts."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * len(ids) + self.used, self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        count = np.array(count, np.int64)
        at = self.used + np.cumsum(count) - count
        self.used += len(ids)
        return at, count

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[bytes], mixed: list[bool]) -> tuple[list[int], list[int]]:
        """All ids, and how many each unit has. Units that are one token of the pre-tokenizer go to the model itself, in byte-level writing."""
        ids, count, tokenize = [], [], self.tokenizer.model.tokenize
        rest = iter(self.whole([u.decode() for u, m in zip(units, mixed, strict=True) if m]))
        for u, m in zip(units, mixed, strict=True):
            if m:
                got = next(rest)
            elif u == b"\n":
                got = self.feed
            elif u.isascii():
                got = [t.id for t in tokenize("\u0120" + u[1:].decode() if u[0] == 32 else u.decode())]
            else:
                got = [t.id for t in tokenize("".join([SHOWN[c] for c in u]))]
            ids += got
            count.append(len(got))
        return ids, count

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by ``end_id`` if there is one, and where each text's begin."""
        docs = len(off) - 1
        gap = (buf == 32) | (buf == 10)
        odd = np.zeros(docs, bool)
        odd[off[1:] == off[:-1]] = False
        if self.by_unit:
            two = np.flatnonzero(gap[1:] & gap[:-1])
            where = np.searchsorted(off, two, "right") - 1
            odd[where[two + 1 < off[where + 1]]] = True
            full = np.flatnonzero(off[1:] > off[:-1])
            odd[full[buf[off[1:][full] - 1] == 32]] = True
            for i in np.unique(np.searchsorted(off, np.flatnonzero(_OTHER[buf]), "right") - 1):
                odd[i] = odd[i] or _WHITE.search(buf[off[i] : off[i + 1]].tobytes()) is not None
        else:
            odd[:] = off[1:] > off[:-1]
        # units begin at texts' starts, and in regular texts at spaces, line feeds and after line feeds
        begin = np.zeros(len(buf) + 1, bool)
        begin[:-1] = gap
        begin[1:] |= buf == 10
        for i in np.flatnonzero(odd):
            begin[off[i] : off[i + 1]] = False
        begin[off[:-1]] = True
        begin[-1] = False
        start = np.flatnonzero(begin)
        # and where letters and marks meet, if a unit has nothing else
        kind = KIND[buf]
        times = np.flatnonzero(buf[:-1] == 0xC3)
        times = times[(buf[times + 1] == 0x97) | (buf[times + 1] == 0xB7)]  # the two signs among the letters
        kind[times] = 0
        odd_bytes = np.flatnonzero(kind == 0)
        mixed = np.zeros(len(start), bool)
        mixed[np.searchsorted(start, odd_bytes, "right") - 1] = True
        cut = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1  # of letters, 1, and marks, 2
        cut = cut[~begin[cut]]
        of = np.searchsorted(start, cut, "right") - 1
        number = np.searchsorted(off, start, "right") - 1
        begin[cut[~mixed[of] & ~odd[number[of]]]] = True
        mixed_at, start = start[mixed], np.flatnonzero(begin)
        mixed = np.zeros(len(start), bool)
        mixed[np.searchsorted(start, mixed_at)] = True
        doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(start, off)))
        end = np.append(start[1:], len(buf))
        key = self._hashes(buf, start, end)
        index = np.full(len(start), -1, np.int64)
        if self.n > MEMO:
            self._forget()
        regular = np.flatnonzero(~odd[doc])
        slot = self._slots(key[regular], False)
        index[regular] = np.where(slot >= 0, self.index[slot], -1)
        unseen = regular[slot < 0]
        one, first, where = np.unique(key[unseen], return_index=True, return_inverse=True)
        first = unseen[first]
        known = np.full(len(one), -1, np.int64)
        long = end[first] - start[first] > MEMO_BYTES
        encoded = lambda new: self.units([buf[a:b].tobytes() for a, b in zip(start[first[new]], end[first[new]], strict=True)], mixed[first[new]].tolist())
        stay, go = np.flatnonzero(~long), np.flatnonzero(long)
        if len(stay):
            at, count = self._pooled(*encoded(stay))
            if self.n + len(stay) > len(self.at):
                grown = np.zeros(2 * (self.n + len(stay)), np.int64)
                self.at, self.count = np.concatenate([self.at[: self.n], grown]), np.concatenate([self.count[: self.n], grown])
            known[stay] = np.arange(self.n, self.n + len(stay))
            self.at[self.n : self.n + len(stay)], self.count[self.n : self.n + len(stay)] = at, count
            self._put(one[stay], np.arange(self.n, self.n + len(stay), dtype=np.int32))
            self.n += len(stay)
        kept = self.used
        # what is not remembered: long units, whole texts, the end
        rest = np.flatnonzero(odd)
        ids, count = encoded(go)
        for got in [*self.whole([buf[off[i] : off[i + 1]].tobytes().decode() for i in rest]), [] if end_id is None else [end_id]]:
            ids += got
            count.append(len(got))
        at, count = self._pooled(ids, count)
        extra = len(at)
        self.used = kept
        at, count = np.concatenate([self.at[: self.n], at]), np.concatenate([self.count[: self.n], count])
        known[go] = self.n + np.arange(len(go))
        index[unseen] = known[where]
        place = np.searchsorted(doc, rest)
        index[place] = self.n + len(go) + np.arange(len(rest))
        # the end of each text is a unit of its own
        index = np.insert(index, np.searchsorted(doc, np.arange(docs), "right"), self.n + extra - 1)
        last = np.searchsorted(doc, np.arange(docs), "right") + np.arange(docs)
        at, count = at[index], count[index]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total[last + 1]])

    @staticmethod
    def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(start), U), 0
        while i < len(start):
            a = start[i]
            j = max(i + 1, int(np.searchsorted(end, a + SPAN, "right")))
            n = int(end[j - 1] - a)
            if n <= SPAN:  # a longer one is a whole text, or not remembered but for this text
                total = np.zeros(n + 1, U)
                np.cumsum(BYTE[buf[a : a + n]] * powers(n)[:n], out=total[1:])
                out[i:j] = mix((total[end[i:j] - a] - total[start[i:j] - a]) * powers(n, INVERSE)[start[i:j] - a] + (end[i:j] - start[i:j]).astype(U))
            else:
                out[i] = int.from_bytes(hashlib.blake2b(buf[a : a + n].tobytes(), digest_size=8).digest(), "little")
            i = j
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.view(U) + U(level * 2 + 1)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, arrays, left, level = [], [], keys.astype(np.int64), 0
        while len(left):
            size = max(64, 2 * len(left))
            at = cls._at(left, level, size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            arrays.append(count == 1)
            left, level = left[count[at] != 1], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(arrays) if arrays else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level takes."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + self._at(keys[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return self.sizes.astype("<i8").tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, levels: bytes, bits: bytes) -> PerfectHash:
        sizes = np.frombuffer(levels, "<i8")
        return cls(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U) ^ U(0x5BD1E995)) >> U(32)).astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, part_rows: int = 50_000) -> None:
    """Encode every whole text, add ``end_id``, and write the store at ``path`` in ascending order of the ids.

    A null text is empty, and so has the end id alone. Rows with a null id can't be looked up and are left out. Rows
    repeated under one id follow each other in the order of their texts. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.select("id").count() // part_rows))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        enc = encoder(tokenizer)
        kind = enc.kind
        part, keys, starts, at, block, held, n = 0, [], [], 0, 0, [], 0

        def row(**values):
            full = {k: values.get(k) for k in SCHEMA.names}
            return pa.RecordBatch.from_pylist([full], schema=SCHEMA)

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            ids = batch.column(0).to_numpy()
            buf, off = texts(batch.column(1))
            for a, b, own, begin in pieces(buf, off, STEP):
                got, first = enc.encode(own, begin, end_id)
                starts.append(at + first[:-1])
                keys.append(ids[a:b])
                held.append(got)
                at += len(got)
                n += len(got)
                if n >= BLOCK:
                    all_ = np.concatenate(held)
                    for i in range(0, n - BLOCK + 1, BLOCK):
                        yield row(kind="payload", part=part, block=block, ids=all_[i : i + BLOCK].tobytes())
                        block += 1
                    held = [all_[n - n % BLOCK :].copy()]
                    n %= BLOCK
        if not keys:
            return
        if n:
            yield row(kind="payload", part=part, block=block, ids=np.concatenate(held).tobytes())
        keys, starts = np.concatenate(keys), np.concatenate(starts)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        own, begin = keys[first], starts[first]
        hashed = PerfectHash.build(own)
        slot = hashed.slots(own)
        prints, places = np.zeros(len(own), "<u4"), np.zeros(2 * len(own), "<i8")
        prints[slot] = fingerprint(own)
        places[2 * slot], places[2 * slot + 1] = begin, np.concatenate([begin[1:], [at]])
        levels, bits = hashed.dump()
        yield row(kind="index", part=part, width=kind.itemsize, first_id=int(keys[0]), n_ids=at, n_keys=len(keys), low=int(keys[0]), high=int(keys[-1]), levels=levels, bits=bits, fingerprints=prints.tobytes(), starts=places.tobytes())

    ordered.mapInArrow(run, WRITTEN).write.partitionBy("kind").option("compression", "zstd").parquet(path)


SCHEMA = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("width", pa.int32()), *[(n, pa.int64()) for n in ("first_id", "n_ids", "n_keys", "low", "high")], *[(n, pa.binary()) for n in ("levels", "bits", "fingerprints", "starts")]])


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(WRITTEN).parquet(path).where(F.col("kind") == kind)


def bases(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids of all parts before; one small row for each part goes through the driver."""
    rows = sorted(_table(spark, path, "index").select("low", "part", "n_ids").collect())
    before = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int64)
    return spark.createDataFrame([(r[1], int(b)) for r, b in zip(rows, before, strict=False)], "part int, base long")


class Part:
    """A part's index in memory."""

    def __init__(self, row: dict):
        self.kind = np.dtype(f"<u{row['width']}")
        self.hash = PerfectHash.load(row["levels"], row["bits"])
        self.prints, self.places = np.frombuffer(row["fingerprints"], "<u4"), np.frombuffer(row["starts"], "<i8").reshape(-1, 2)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(start, end) in ids of each key, -1 where it isn't stored."""
        slot = self.hash.slots(keys)
        out = np.full((len(keys), 2), -1)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        out[ok] = self.places[slot[ok]]
        return out


def _part_of(spark: SparkSession, path: str):
    """A column function: the part that holds a key if any does. One small row for each part goes through the driver."""
    edges = sorted(tuple(r) for r in _table(spark, path, "index").select("low", "part").collect())
    lows, parts = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)

    @F.pandas_udf("int")
    def part_of(k):
        import pandas as pd

        at = np.searchsorted(lows, k.to_numpy(np.int64), "right") - 1
        return pd.Series(np.where(at >= 0, parts[np.maximum(at, 0)], -1).astype(np.int32) if len(parts) else np.full(len(at), -1, np.int32))

    return part_of, len(parts)


def lookup(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) of the keys that the store holds.

    Each key goes to the part whose range it is in and is found by that part's perfect hash; then only the blocks that
    its ids lie in are read (parts that nobody asks for are skipped by the files' statistics). start counts from the
    part's first id. ids are little-endian unsigned 32-bit integers. Null keys are left out, repeated ones count once.
    """
    scratch = Scratch(spark, "lookup")
    part_of, _ = _part_of(spark, path)
    asked = keys.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct().withColumn("part", part_of("id")).where("part >= 0")
    asked = scratch.save(asked, "asked")
    parts = [r[0] for r in asked.select("part").distinct().collect()]
    wanted = lambda kind: _table(spark, path, kind).where(F.col("part").isin(parts))

    def find(asked_rows, index_rows):
        if not asked_rows.num_rows or not index_rows.num_rows:
            return SPANS.empty_table()
        row = index_rows.to_pylist()[0]
        ids = asked_rows.column("id").to_numpy()
        found = Part(row).find(ids)
        ok = (found[:, 0] >= 0) & (found[:, 1] > found[:, 0])
        n = int(ok.sum())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((np.full(n, row["part"]), ids[ok], found[ok, 0], found[ok, 1], np.full(n, row["width"])), SPANS.types, strict=True)], schema=SPANS)

    index = wanted("index").select("part", "width", "levels", "bits", "fingerprints", "starts")
    spans = asked.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(find, "part int, id long, start long, end long, width int")
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)).cast("array<int>")))
    blocks = wanted("payload").select("part", "block", "ids")

    def cut(batches):
        for batch in batches:
            out = []
            for ids, width, key, start, end, block in zip(batch.column(0), *(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                held = np.frombuffer(ids.as_buffer(), f"<u{width}")
                low = block * BLOCK
                out.append((key, start, end, block, held[max(start - low, 0) : end - low].astype("<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["id", "start", "end", "block", "ids"])

    pieces_ = spans.join(blocks, ["part", "block"]).select("ids", "width", "id", "start", "end", "block").mapInArrow(cut, "id long, start long, end long, block int, ids binary")
    one = pieces_.groupBy("id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("of"))
    whole = F.aggregate("of", F.lit(b""), lambda got, x: F.concat(got, x["ids"]))
    return one.select(F.col("id").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.crc32(whole).alias("ids_crc32"), whole.alias("ids"))


SPANS = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("width", pa.int32())])


def read(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``keys`` (one row each, repeats too) with start, n_tokens and ids_crc32 read back from the store's files.

    A part is read block by block in one stream: its keys, sorted, come before its index and its payload.
    """
    index = _table(spark, path, "index")
    base = {r["part"]: r["base"] for r in bases(spark, path).collect()}
    part_of, n_parts = _part_of(spark, path)
    ids = keys.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"))
    asked = ids.withColumn("part", part_of("id")).select("part", F.lit(-2).alias("block"), "id")
    own = index.select("part", F.lit(-1).alias("block"), "width", "levels", "bits", "fingerprints", "starts").unionByName(_table(spark, path, "payload").select("part", "block", "ids"), allowMissingColumns=True)
    rows = asked.unionByName(own, allowMissingColumns=True).select("part", "block", "id", "width", "levels", "bits", "fingerprints", "starts", "ids")

    def run(batches):
        state: dict = {}

        def done():
            if state.get("want") is not None and state["at"] < len(state["want"]):
                raise ValueError("the payload ends before its index says")

        for batch in batches:
            part_no, block_no = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (part_no[1:] != part_no[:-1]) | (block_no[1:] != block_no[:-1]), [True]]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if state.get("part") != part_no[a]:
                    done()
                    state = {"part": part_no[a], "asked": [], "at": 0, "tail": b"", "seen": 0}
                if block_no[a] == -2:
                    state["asked"].append(batch.column(2).slice(a, b - a).to_numpy())
                    continue
                row = batch.slice(a, 1).to_pylist()[0]
                if block_no[a] == -1:
                    p, ask = Part(row), np.concatenate(state["asked"]) if state["asked"] else np.zeros(0, np.int64)
                    span = p.find(ask)
                    ask, span = ask[span[:, 0] >= 0], span[span[:, 0] >= 0]
                    order = np.lexsort((ask, span[:, 0]))
                    state |= {"kind": p.kind, "want": list(zip(ask[order].tolist(), span[order].tolist(), strict=True)), "base": base[int(part_no[a])]}
                    continue
                tail = state["tail"] + row["ids"]
                w, low = state["kind"].itemsize, state["seen"]
                high, want, out = low + len(tail) // w, state["want"], []
                while state["at"] < len(want) and want[state["at"]][1][1] <= high:
                    k, (s, e) = want[state["at"]]
                    x = np.frombuffer(tail, state["kind"], e - s, (s - low) * w).astype("<u4")
                    out.append((k, state["base"] + s, e - s, zlib.crc32(x.tobytes())))
                    state["at"] += 1
                keep = want[state["at"]][1][0] if state["at"] < len(want) else high
                state |= {"tail": tail[(min(keep, high) - low) * w :], "seen": min(keep, high)}
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        done()

    n = max(1, n_parts)
    return rows.repartition(n, "part").sortWithinPartitions("part", "block", "id").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from a store that is written and read back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = scratch.path("store")
    write(docs, path, tokenizer, end_id, id_col, text_col)
    return read(docs.sparkSession, path, docs, id_col)
