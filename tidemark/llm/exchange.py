"""Finding the keys that more than one owner has, among far more keys than should be shuffled as rows.

Each mapper sorts its keys, settles the ones that several of its own owners share, and sends the others on as packed
arrays of five-byte keys, one row for each bucket of the key space. A key that is very common so reaches the reducer
once for each mapper's chunk at most, however many owners have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import U, mix, tidy

#: Keys that a mapper gathers before it sends them on.
CHUNK = 500_000
#: Keys that a bucket should hold.
BUCKET = 1_000_000
PACKED = pa.schema([("bucket", pa.int32()), ("direct", pa.bool_()), ("base", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()), ("settled", pa.binary())])
PACKED_DDL = "bucket int, direct boolean, base long, keys binary, owners binary, places binary, settled binary"
ROWS = pa.schema([("key", pa.int64()), ("owner", pa.int64()), ("place", pa.int64())])
ROWS_DDL = "key long, owner long, place long"


def narrow(x: np.ndarray) -> bytes:
    """The width in bytes, then the values in as few bytes as the largest needs."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)


def bits_for(keys: float) -> int:
    """Of the bucket's number, for about so many keys in all."""
    return int(max(4, min(24, np.ceil(np.log2(max(1.0, keys / BUCKET))))))


def _pack(key, owner, place, bits: int, width: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(key)
    key, owner, place = key[order], owner[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.repeat(np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin), np.diff(np.append(begin, len(key))))
    lead = np.zeros(len(key), bool)
    lead[begin] = True
    rows = []
    if several.any():  # known to be shared: these go out as they are, to any bucket
        for part in np.array_split(np.flatnonzero(several), max(1, several.sum() // 50_000)):
            base = int(owner[part].min())
            rows.append((int(mix((key[part[:1]] + owner[part[:1]].astype(U)))[0] >> U(64 - bits)), True, base, b"\x08" + key[part].tobytes(), narrow(owner[part] - base), narrow(place[part]), b""))
    keep = np.flatnonzero(~several | lead)
    key, owner, place, settled = key[keep], owner[keep], place[keep], several[keep]
    bucket = (key >> U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    short = (((key << U(bits)) >> U(24)) if width == 5 else key).view(np.uint8).reshape(-1, 8)[:, :width]
    for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
        base = int(owner[a:b].min())
        rows.append((int(bucket[a]), False, base, short[a:b].tobytes(), narrow(owner[a:b] - base), narrow(place[a:b]), np.packbits(settled[a:b]).tobytes()))
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), PACKED.types, strict=True)], schema=PACKED)


def _settle(rows: list[dict], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket: the keys with several owners."""
    direct, rows = [r for r in rows if r["direct"]], [r for r in rows if not r["direct"]]
    for r in direct:
        key = np.frombuffer(r["keys"], np.int64, offset=1)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(wide(r["owners"]) + r["base"]), pa.array(wide(r["places"]))], schema=ROWS)
    if len(rows) < 2:
        return
    short = np.concatenate([np.frombuffer(r["keys"], np.uint8).reshape(-1, width) for r in rows])
    full = np.zeros((len(short), 8), np.uint8)
    full[:, :width] = short
    key = full.view(np.uint64).ravel()
    owner = np.concatenate([wide(r["owners"]) + r["base"] for r in rows])
    place = np.concatenate([wide(r["places"]) for r in rows])
    settled = np.concatenate([np.unpackbits(np.frombuffer(r["settled"], np.uint8), count=len(r["keys"]) // width) for r in rows]).astype(bool)
    order = np.argsort(key)
    key, owner, place, settled = key[order], owner[order], place[order], settled[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
    several = np.repeat(several, np.diff(np.concatenate([begin, [len(key)]]))) & ~settled
    if several.any():
        out = key[several]
        if width == 5:
            out = (out << U(24)) >> U(bits) | U(rows[0]["bucket"]) << U(64 - bits)
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(owner[several]), pa.array(place[several])], schema=ROWS)


def shared_keys(df: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], keys: float, exact: bool = False) -> DataFrame:
    """(key, owner, place) of every key that two owners or more have.

    ``emit`` gives keys (uint64, well mixed), owners (int64) and places (int64, not negative) of a batch. ``keys`` is
    about how many there are; it sets the number of buckets. Keys are told apart by 40 bits and the bucket's number,
    so a few that are not shared may come too: callers compare what they stand for. With ``exact`` all 64 bits go along.
    """
    bits = bits_for(keys)
    width = 8 if exact else 5
    low = U(2**64 - 1) if exact else ~U((1 << max(0, 24 - bits)) - 1)

    def send(batches):
        held, n = [], 0
        for batch in batches:
            for key, owner, place in emit(batch):
                if len(key):
                    held.append((key & low, owner.astype(np.int64), place.astype(np.int64)))
                    n += len(key)
                if n >= CHUNK:
                    yield from _pack(*map(np.concatenate, zip(*held, strict=True)), bits, width)
                    held, n = [], 0
        if n:
            yield from _pack(*map(np.concatenate, zip(*held, strict=True)), bits, width)

    def settle(batches):
        bucket, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if rows:
                        yield from _settle(rows, bits, width)
                    bucket, rows = row["bucket"], []
                rows.append(row)
        if rows:
            yield from _settle(rows, bits, width)

    parts = max(1 << bits, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.mapInArrow(tidy(send), PACKED_DDL).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(settle), ROWS_DDL)
