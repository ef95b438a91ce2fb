import hashlib
import random

import pytest

from tidemark.llm.suffix_dedup import deduplicated


def brute(rows, n=50):
    texts = {}
    for i, t in rows:
        if i is not None:
            t = (t or "").encode()
            texts[i] = min(texts.get(i, t), t)
    seen, out = set(), set()
    for i in sorted(texts):
        t = texts[i]
        gone, own = bytearray(len(t)), []
        for p in range(len(t) - n + 1):
            own.append(t[p : p + n])
            if own[-1] in seen:
                gone[p : p + n] = b"\x01" * n
        seen.update(own)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.add((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcé \n") for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 60, 90, 200, 700)]
    rows = []
    for i in range(120):
        parts = [say(r.randint(0, 80))]
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2) if r.random() < 0.5 else 0
            parts += [s[a : a + r.randint(20, len(s))], say(r.randint(0, 60))]
        rows.append((i * 3, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 300), (503, "b" + "a" * 120), (504, "ab" * 200), (505, "ab" * 40 + "x"), (506, rows[3][1]), (507, rows[3][1]), (None, rows[3][1]), (508, "x" * 49), (509, "x" * 49)]
    rows += [rows[5], (rows[6][0], "zz")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, place int, key string").repartition(5)
    got = {tuple(r) for r in deduplicated(df).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = spark.createDataFrame([(1, "q" * 60), (2, "q" * 60)], "doc_id long, text string")
    assert [(r.doc_id, bytes(r.kept)) for r in deduplicated(one, with_text=True).orderBy("doc_id").collect()] == [(1, b"q" * 60), (2, b"")]


def test_longer_strings_that_differ_in_the_middle_stay(spark):
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for k in range(30):
        start, end = say(66), say(40)
        rows += [(2 * k, start + say(34) + end), (2 * k + 1, start + say(34) + end)]  # no 100 bytes in common
    rows += [(100, say(150)), (101, rows[0][1] + "tail")]
    got = {x.doc_id: bytes(x.kept).decode() for x in deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), length=100, with_text=True).collect()}
    assert [i for i, t in rows if got[i] != t] == [101]
