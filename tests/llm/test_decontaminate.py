import itertools
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import MASKS, RUN, SHORT, WINDOW, Slice, clean_documents, contaminated, needed


def test_masks_hit_every_window_with_two_substitutions():
    for r in (0, 1, 2):
        for gone in itertools.combinations(range(WINDOW), r):
            assert any(all(m[j] == "0" or o + j not in gone for j in range(len(m))) for m in MASKS for o in range(WINDOW - len(m) + 1))


def case(seed=1):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(n) for n in (13, 20, 40, 60, 8, 3)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for subs in range(4):
            n = min(13, len(item))
            at = r.randrange(len(item) - n + 1)
            part = item[at : at + n]
            for j in r.sample(range(n), min(subs, n)):
                part[j] = "other"
            docs.append(say(r.randint(0, 300)) + part + say(50))
            if len(item) >= 13 and subs <= 2 or len(item) == 8 and subs <= 1:
                want.add((len(docs) - 1, i))
    docs += [say(500) for _ in range(20)]
    return [(k, " ".join(d).upper() if k % 3 == 0 else ", ".join(d)) for k, d in enumerate(docs)], [(i, " ".join(x)) for i, x in enumerate(items)], want


def test_planted_passages(spark):
    docs, items, want = case()
    docs += [(900, None), (901, ""), (None, items[2][1])]
    bench = spark.createDataFrame([*items, (77, None), (None, "x y")], "item_id long, text string")
    df = spark.createDataFrame([(d, t, "u", 0.0) for d, t in docs], "doc_id long, text string, item_id string, n_equal double")
    got = contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_equal >= needed(r.n_words)[1] for r in got)
    kept = clean_documents(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs if d is not None and d not in {w[0] for w in want}}
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_a_run_is_left_of_short_items_with_one_substitution():
    for size in range(SHORT, WINDOW):
        for gone in range(size):
            assert any(not o <= gone < o + len(RUN) for o in range(size - len(RUN) + 1))


def brute(docs, items, least):
    tokens = lambda t: re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", (t or "").lower())
    out = set()
    for d, text in docs:
        for i, item in items:
            x, y = tokens(text), tokens(item)
            if d is None or i is None or len(y) < max(1, least):
                continue
            size, equal = needed(len(y))
            found = [(-sum(u == v for u, v in zip(x[a : a + size], y[b : b + size])), a, b) for a in range(len(x) - size + 1) for b in range(len(y) - size + 1)]
            if found and -min(found)[0] >= equal:
                n, a, b = min(found)
                out.add((d, i, a, b, size, -n))
    return out


@pytest.mark.parametrize("least,pairs", [(5, 50_000), (1, 7)])
def test_equals_brute_force_with_few_distinct_words(spark, monkeypatch, least, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    r = random.Random(4)
    say = lambda n, v: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz"[:v]) for _ in range(n))
    items = [(i, say(n, v)) for i, (n, v) in enumerate([(1, 9), (3, 9), (5, 4), (7, 3), (8, 3), (10, 4), (12, 3), (13, 4), (16, 3), (25, 4), (30, 1), (14, 26), (0, 1)])]
    docs = [(d, say(r.randint(0, 60), r.choice([1, 2, 3, 4, 26])) + " " + items[r.randrange(len(items))][1]) for d in range(40)]
    slices = Slice([i for i, _ in items], [t for _, t in items], least)
    got = set()
    for batch in (docs[:25], docs[25:]):
        raw = [t.encode() for _, t in batch]
        for d, *rest in slices.hits(*decontaminate.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), decontaminate.PUNCT)):
            got.add((batch[d][0], *rest))
    assert got == brute(docs, items, least)
    if least == 5:
        df = spark.createDataFrame([*docs, docs[3]], "doc_id long, text string").repartition(3)
        assert {tuple(x) for x in contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == got


def test_very_long_texts_of_equal_words():
    part = Slice([1, 2], ["same " * 60, " ".join(f"w{i % 7}" for i in range(60))])
    for text in ("same " * 200_000, " ".join(f"w{i % 7}" for i in range(200_000)), "same other " * 100_000):
        began = time.process_time()
        raw = np.frombuffer(text.encode(), np.uint8)
        got = list(part.hits(*decontaminate.words(raw, np.array([0, len(raw)]), decontaminate.PUNCT)))
        assert time.process_time() - began < 30 and len(got) == (text[:10] != "same other")


@pytest.mark.parametrize("least", [1, 5])
def test_join_of_seeds_equals_slices(spark, least):
    docs, items, _ = case(3)
    r = random.Random(9)
    half = [" ".join(items[i][1].split()[:20]) for i in (1, 2, 3)]
    docs += [(900, None), (901, ""), (None, items[2][1]), (902, items[2][1]), (902, items[2][1]), (903, " ".join(["again"] * 3000)), (904, " ".join(r.choice(half) for _ in range(400))), (905, "one two"), (906, "."), (907, "x " + items[4][1])]
    items += [(50, items[2][1]), (51, items[2][1] + " and more"), (51, "one two"), (52, " ".join(["again"] * 40)), (53, ""), (54, "one"), (77, None), (None, "x y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(d, t, "u", 0.0) for d, t in docs], "doc_id long, text string, item_id string, n_equal double").repartition(5)
    slices, joined = (sorted(map(tuple, contaminated(df, bench, least=least, join_above=n).collect())) for n in (10**9, 0))
    assert slices == joined and len(joined) > 30
    kept = clean_documents(df, bench, least=least, join_above=0)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean_documents(df, bench, least=least).collect()))
    assert clean_documents(df.limit(0), bench, join_above=0).count() == 0 and contaminated(df.limit(0), bench, join_above=0).count() == 0
    few = contaminated(df, spark.createDataFrame([(1, "a b c")], "item_id long, text string"), join_above=0)
    assert few.count() == 0


def test_join_with_a_full_filter_finds_the_same(spark):
    docs, items, want = case(4)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "i long, t string")
    got = decontaminate._joined(df, "text", bench, 5, bits=64).collect()
    assert len(got) == len({(r.doc_key, r.item_key) for r in got}) == len(want)
