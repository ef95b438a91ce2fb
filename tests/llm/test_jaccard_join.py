import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.jaccard_join import apart, bands, jaccard_components, near_duplicates_dropped, shape, signed, sketches
from tidemark.llm.scratch import Scratch
from tidemark.llm.text import mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {(i, len(s), top(i)) for i, s in sets.items()}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "Zz"]
    rows = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 12, 40, 200, 900]))]
        for _ in range(r.choice([1, 2, 6])):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = r.choice(vocab)
            if r.random() < 0.3:
                own = own[: int(len(own) * r.uniform(0.88, 1)) or 1]
            rows.append(r.choice([" ", "\n", "\t\x0b"]).join(own).upper() if r.random() < 0.2 else " ".join(own))
    rows += [None, "", "  \n", "a", "A", "a b", "x\x85y z q", "x y z q"]
    r.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 8, 10)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n int")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_large_loose_groups_in_blocks(spark, monkeypatch):
    from tidemark.llm import jaccard_join

    for name, n in (("FEW", 2), ("ROWS", 7), ("COLUMNS", 11)):
        monkeypatch.setattr(jaccard_join, name, n)
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(80)] = f"x{r.randint(0, 40)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_components(df, 3, 9, 10).collect()}
    assert got == brute(rows, 3, 9, 10) and len({c for *_, c in got}) > 3


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 9, 10, 37, 90, 130, 400):
        for _ in range(30):
            a = np.sort(mix(rng.integers(1, 2**62, n).astype(np.uint64)))
            b = a[np.sort(rng.permutation(n)[int(rng.integers(0, n // 5 + 1)) :])]
            if 10 * len(b) >= 8 * n and len(b):
                key, owner, _, room = signed(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 8, 10)
                assert set(key[owner == 0]) & set(key[owner == 1])
                assert room.max() <= shape(int(bands(8, 10, n)[-1]), 8, 10)[3]


def test_sketches_never_tell_more_than_the_sets_differ():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (30, 31), (255, 256), (300, 240), (5000, 4100)):
        a = np.unique(mix(rng.integers(0, 2**62, n).astype(np.uint64)))
        b = np.unique(np.concatenate([a[: m // 2], mix(rng.integers(0, 2**62, m - m // 2).astype(np.uint64))]))
        x, y = sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert apart(x, x) == 0 < apart(x, y) + (n == 1) and apart(x, y) <= len(np.setxor1d(a, b))


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g")], schema)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect()) == [(1, 1), (3, 1)]
    kept = near_duplicates_dropped(df)
    assert kept.columns == ["doc_id", "text"] and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_links_of_ids_join_their_labels(spark):
    """An id that has another's label brings all of that label along."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "id long, label long")
    edges = spark.createDataFrame([(2, 4)], "a long, b long")
    got = {r["id"]: r["label"] for r in jaccard_join._joined(labels, edges, Scratch(spark, "joined")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
