import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.language import identified, languages, letter_bits, prototypes, vectors

DDL = "doc_id long, text string, lang string, score string, held_out int"
WORDS = {"aa": "kalo menu tari solen marim", "bb": "dwurst schlaf grunz pfitz", "cc": "éàù çelle oiseau ñoqué"}


def letter(c):
    return 1 - 2 * np.unpackbits(letter_bits(np.array([c]))[0][0]).astype(int)


def brute(text):
    """A text's vector by the definition, run by run, over Python's own letters."""
    text = text or ""
    low = [ord(ch.lower()[0]) if ch.isalpha() else 0 for ch in text]
    low, out, n = [0, *low, 0], np.zeros(language.DIM, int), 0
    for a, b, c in zip(low, low[1:], low[2:]):
        if b:
            n += 1
            out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return out, n


def made(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(1, 40)))), lang, "x", 1) for i in range(n) for lang in [sorted(WORDS)[i % 3]]]


ODD = [None, "", "a", "ab", "1 2 3", "The THE the", "été ÉTÉ", "日本語 текст", "a1b", "İx", "🙂🙂", "x" * 50, "\x00a\x00"]


def test_vectors_equal_the_definition(monkeypatch):
    texts = ODD + [" ".join(w) for w in (["Straße", "äöü"] * 30, ["日本", "ab"] * 40)]
    for piece, runs in ((1 << 19, 4096), (7, 3)):  # the latter cuts texts into parts and runs into blocks
        monkeypatch.setattr(language, "PIECE", piece)
        monkeypatch.setattr(language, "RUNS", runs)
        v, letters = vectors(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            want, n = brute(t)
            assert letters[i] == n and np.array_equal(v[i], want), (piece, t)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)  # three languages: two passes, and sums sent on early
    rows = made(120, 1) + [(1000 + i, t, lang, "x", 1) for i, t in enumerate(ODD) for lang in ("aa", None)] + [(None, "kalo tari", "bb", "x", 1), (5, "menu", "aa", "x", 1), (5, "menu", "aa", "x", 1)]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    proto = {}
    for i, t, lang, *_ in rows:
        if not held(i) and lang is not None and t is not None:
            proto[lang] = proto.get(lang, 0) + brute(t)[0]
    want = []
    for i, t, *_ in rows:
        v, n = brute(t)
        cos = sorted((-float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), lang) for lang, p in proto.items()) if n else []
        want.append((i, held(i), cos[0][1] if n else "und", round(max(0.0, -cos[0][0]), 9) if n else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in languages(df).collect()]
    assert Counter(got) == Counter(want)
    monkeypatch.setattr(language, "LANGUAGES", 1024)
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in languages(df.repartition(1)).collect()) == Counter(want)


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(made(600, 2), DDL)
    got = languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[1] > 60 and got[0] > 0.99


def test_very_long_text_and_nothing_learned(spark):
    long = "oiseau çelle " * 300_000
    df = spark.createDataFrame([(0, long, "cc", "x", 1), (1, "oiseau", None, "x", 1), (2, None, None, "x", 1), (3, "schlaf", "bb", "x", 1)], DDL)
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in identified(df, prototypes(df)).collect()}
    assert got == {0: ("cc", None), 1: ("cc", None), 2: ("und", None), 3: ("bb", None)}
    none = identified(df, prototypes(df.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == 4
    assert languages(df.limit(0)).collect() == []
