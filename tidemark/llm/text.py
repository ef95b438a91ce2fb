"""Word and byte fingerprints of Arrow string columns, computed over whole batches with numpy.

All hashes are 64 bits wide and the same in every process. Words are ``[^\\x20\\x09-\\x0D]+``; only A-Z is lower-cased.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes that are hashed at a time; a longer document is a piece of its own.
PIECE = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For words without punctuation: all ASCII but letters and digits.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands the memory it has freed back to the system, as Python workers stay for the next task."""

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none, and need none
        if trim is not None:
            trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits, one to one (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    #: A random odd number for each byte, and powers for the places in a word.
    BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
#: The byte's number after lower-casing, and what the powers of places in a word, and their inverses, are powers of.
FOLDED = BYTE[LOWER]
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
SPAN = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """The first n powers (or some more) of an odd number, modulo 2**64."""
    had = _POWERS.get(base)
    if had is None or len(had) < n:
        had = np.full(max(n, 1 << 12), base, U)
        had[0] = 1
        _POWERS[base] = had = np.cumprod(had, dtype=U)
    return had


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and each one's start, with the end last. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents, about ``most`` bytes at a time: first, end, their bytes, their starts."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and where each document's words begin, with the end last. ``space``: the bytes between words.

    A word's hash is a difference of two running sums over the text, moved to the word's start by an inverse power.
    """
    inside = ~space[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = off[(off > 0) & (off < len(buf))]
    before[cut] = after[cut - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    out, first, i = np.empty(len(start), U), np.searchsorted(start, off), 0
    while i < len(start):  # so much text at a time as a processor's cache holds
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + SPAN, "right")))
        n = int(end[j - 1] - a)
        total = np.zeros(n + 1, U)
        np.cumsum(FOLDED[buf[a : a + n]] * powers(n)[:n], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * powers(n, INVERSE)[s])
        i = j
    return out, first


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of k words and where each document's runs begin. A document of fewer words (but some) has one run, the whole."""
    count = np.diff(first)
    out, n = np.zeros(max(0, len(hashes) - k + 1), U), max(0, len(hashes) - k + 1)
    for j in range(k):
        out += hashes[j : j + n] * (powers(k + 1)[j + 1] | U(1))
    out = mix(out + U(k))
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(runs)])
    got = np.zeros(begin[-1], U)
    doc = np.repeat(np.arange(len(count)), runs)
    place = np.arange(len(got)) - begin[doc]
    full = count[doc] >= k
    got[full] = out[first[:-1][doc[full]] + place[full]]
    for i in np.flatnonzero((count > 0) & (count < k)):
        s = hashes[first[i] : first[i + 1]]
        got[begin[i]] = mix((s * (powers(k + 1)[1 : len(s) + 1] | U(1))).sum(dtype=U) + U(k * 1000 + len(s)))
    return got, begin


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the runs of k words of each document in order, and where each document's begin."""
    got, first = grams(*words(buf, off), k)
    new = np.ones(len(got), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        got[a:b].sort()
    new[1:] = got[1:] != got[:-1]
    new[first[:-1][first[:-1] < len(got)]] = True
    at = np.concatenate([[0], np.cumsum(new)])
    return got[new], at[first]
