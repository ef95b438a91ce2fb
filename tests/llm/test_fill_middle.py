import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle
from tidemark.llm.fill_middle import Bits, digests, fill_in_middle, restored


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for size, share in ((1, 1.0), (64, 0.5), (511, 0.1), (512, 1.0), (513, 0.3), (20_000, 0.01), (70_000, 0.7)):
        flags = rng.random(size) < share
        bits = Bits(size)
        bits.put(0, flags)
        bits.index()
        assert np.array_equal(bits.rank(np.arange(size + 1)), np.concatenate([[0], np.cumsum(flags)]))
        places = np.flatnonzero(flags)
        assert np.array_equal(bits.select(np.arange(len(places))), places)


ODD = [None, "", "a", "<", "<P", "<P>x", "a <S> b", "<<M>", "x<M", "P><S", "ab1é<c\n\n zz", "ßÄö日本語 text", "🙂🙂 ab🙂cd", "<P<S<M>", "   ", "a" * 3000, "é" * 3000, "\x00\x01 a", "S>M>P>"]


@pytest.mark.parametrize("piece", [1 << 9, 2 << 20])
def test_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    rng = np.random.default_rng(1)
    signs = list("abzAZ<PSM> .\né日🙂1")
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choice(signs, int(rng.integers(0, 400))))) for i in range(600)]
    docs += [(None, "no id here"), (7, "an id again"), (7, "an id again")]
    df = spark.createDataFrame([(i, t, "other", 5) for i, t in docs], "doc_id long, text string, output string, n int").repartition(3)
    rows = fill_in_middle(df)
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = rows.select("doc_id", restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in docs), key=repr)
    one = digests(rows.where("doc_id = 10")).first()
    assert one.output_sha256 == hashlib.sha256(brute(*docs[10])[-1].encode()).hexdigest() and one.restored_sha256 == hashlib.sha256(docs[10][1].encode()).hexdigest()


def test_very_long_text_and_empty_table(spark):
    text = "word, Wörter; " * 400_000  # 6 MB, three pieces
    df = spark.createDataFrame([(i, text[i:]) for i in range(3)], "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in fill_in_middle(df).collect()}
    assert got == {i: brute(i, text[i:]) for i in range(3)}
    assert fill_in_middle(df.limit(0)).collect() == [] and digests(fill_in_middle(df.limit(0))).count() == 0
