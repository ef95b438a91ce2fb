"""Fill-in-the-middle transformation by succinct rank and select over token boundaries.

The texts of a batch are one run of bytes. Two packed bitvectors over it mark the bytes at which tokens begin and those at
which code points begin; each keeps the number of set bits before every block of 512. The number of a text's tokens is a
difference of two ranks, the byte at which a token begins is one select, and the code points of a part are a difference
of ranks again, so no list of tokens is ever made, however long a text is.

Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points. A hash of the id and a seed draws the cuts and the form; texts that
hold one of the marks stay plain, so that the marks of an output can be told from its text and ``restored`` is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import PIECE, U, texts, tidy

#: What begins the prefix, the suffix and the middle of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a directory's block, and 64-bit words in it.
BLOCK, WORDS = 512, 8
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


class Bits:
    """A packed bitvector with the number of set bits before each block."""

    def __init__(self, size: int):
        self.words = np.zeros((size // BLOCK + 1, WORDS), U)
        self.before = np.zeros(len(self.words) + 1, np.int64)

    def put(self, at: int, flags: np.ndarray) -> None:
        """Set the bits from ``at``, a multiple of the block, on."""
        packed = np.packbits(flags, bitorder="little")
        self.words.reshape(-1).view(np.uint8)[at // 8 : at // 8 + len(packed)] = packed

    def index(self) -> Bits:
        np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64), out=self.before[1:])
        return self

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block, bit = at // BLOCK, at % BLOCK
        below = np.clip(bit[:, None] - np.arange(WORDS) * 64, 0, 64)
        mask = np.where(below == 64, ~U(0), (U(1) << np.minimum(below, 63).astype(U)) - U(1))
        return self.before[block] + np.bitwise_count(self.words[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of the set bit that has so many before it; there must be one."""
        block = np.searchsorted(self.before, rank, "right") - 1
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        left = rank - self.before[block]
        word = (upto <= left[:, None]).sum(axis=1)
        row = np.arange(len(rank))
        left = left - np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(self.words[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + np.argmax(np.cumsum(bits, axis=1) == left[:, None] + 1, axis=1)


def boundaries(buf: np.ndarray, off: np.ndarray) -> tuple[Bits, Bits]:
    """Where tokens and where code points begin, over all texts of a batch; a text's first byte begins a token."""
    tokens, points = Bits(len(buf)), Bits(len(buf))
    first = off[:-1][np.diff(off) > 0]
    for a in range(0, len(buf), PIECE):
        own = buf[a : a + PIECE]
        lead, letter = (own & 0xC0) != 0x80, LETTER[own]
        after = np.empty(len(own), bool)
        after[1:], after[0] = letter[:-1], a > 0 and LETTER[buf[a - 1]]
        begins = lead & ~(letter & after)
        begins[first[np.searchsorted(first, a) : np.searchsorted(first, a + len(own))] - a] = True
        tokens.put(a, begins)
        points.put(a, lead)
    return tokens.index(), points.index()


def _cut(tokens: Bits, start: np.ndarray, end: np.ndarray, base: np.ndarray, n: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte after so many units of each text."""
    out, inside = end.copy(), units < n
    out[inside] = tokens.select((base + units)[inside])
    out[units == 0] = start[units == 0]
    return out


FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]
DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


@tidy
def _arranged(batches):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        ids, (h1, h2) = batch.column(0), (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        forms = batch.column(4).to_pylist()
        buf, off = texts(batch.column(1))
        tokens, points = boundaries(buf, off)
        start, end = off[:-1], off[1:]
        base = tokens.rank(start)
        n = tokens.rank(end) - base
        u1, u2 = h1 % (n + 1), h2 % (n + 1)
        cut1, cut2 = (_cut(tokens, start, end, base, n, u) for u in (np.minimum(u1, u2), np.maximum(u1, u2)))
        plain = np.array([f == "plain" for f in forms], bool)
        chars = [pa.array(points.rank(y) - points.rank(x), mask=plain) for x, y in ((start, cut1), (cut1, cut2))]
        held, a = memoryview(buf), 0
        while a < len(forms):  # outputs go on a piece at a time
            b = max(a + 1, int(np.searchsorted(off, off[a] + PIECE, "right")) - 1)
            out = []
            for i in range(a, b):
                p, m, s = held[start[i] : cut1[i]], held[cut1[i] : cut2[i]], held[cut2[i] : end[i]]
                order = (p, m, s) if forms[i] == "plain" else (marks[1], s, marks[0], p, marks[2], m) if forms[i] == "spm" else (marks[0], p, marks[1], s, marks[2], m)
                out.append(b"".join(order))
            cols = [ids.slice(a, b - a), pa.array(n[a:b]), batch.column(4).slice(a, b - a), *(c.slice(a, b - a) for c in chars), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[f for f, _ in FIELDS])
            a = b


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text in its form of three parts, or plain.

    Four numbers h1 to h4 are the first groups of eight hex digits of the sha256 of ``seed:id``. Of a text's n tokens the
    prefix takes the smaller of h1 and h2 modulo n + 1, the middle reaches to the larger. A text that is empty or holds a
    mark is plain, and so is one whose h3 % 100 is not under ``plain_from``; one whose h4 % 100 is under ``spm_below`` is
    spm, any other psm.

    A null text counts as empty. A null id draws by ``seed:`` alone. Every row gives one row, repeated ones too; a text
    of any length is cut as a whole; an empty table gives none. Columns other than id and text are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    return rows.select("doc_id", "text", h[0].alias("h1"), h[1].alias("h2"), form.alias("form")).mapInArrow(_arranged, DDL).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts, told by the marks, in their first order."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def digests(rows: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` returns, with hex digests of the output and of the text restored from it in the output's place."""
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c1, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:c1], ''), '') AS pre, coalesce(array_to_string(units[c1 + 1:c2], ''), '') AS mid, coalesce(array_to_string(units[c2 + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
