import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.mixing import mixed, mixture, nearest, split, targets

DDL = "doc_id long, text string, source string, size int, shards string"


def rows():
    r = np.random.default_rng(5)
    out = []
    for i in range(3000):
        s = ["b", "a", "ä", None, "zz"][min(4, int(r.integers(0, 12)) // 2 if i % 3 else 0)]
        n = int(r.integers(0, 60)) if i % 500 else 4000
        out.append((i, "\x0b ".join(["w\x85x"] * n), s, 1, "q"))
    return out + [(9001, None, "a", 1, "q"), (9002, " \t", "only", 1, "q"), (None, "x y", "a", 1, "q")]


def test_targets_share_all_and_stop_at_the_cap():
    size = np.array([100.0, 1.0, 500.0, 0.0])
    got = targets(size, np.array([1.0, 2.0, 3.0, 1.0]), size.sum())
    assert abs(got.sum() - size.sum()) < 1e-9 and (got <= 3 * size + 1e-9).all()
    assert got[1] == 3 and got[3] == 0
    open_ = got < 3 * size - 1e-9
    assert np.ptp((got / np.array([1.0, 2, 3, 1]))[open_]) < 1e-9


def test_split_is_exact_and_even():
    m = np.array([7, 0, 1000, 33])
    q = split(m, 6, np.random.default_rng(1))
    assert (q.sum(0) == m).all() and np.ptp(q.sum(1)) <= 2 and (q >= 0).all()


def test_nearest_is_the_best_subset():
    r = np.random.default_rng(3)
    for _ in range(200):
        sizes = r.integers(1, 60, int(r.integers(1, 11)))
        gap = float(r.integers(1, sizes.sum() + 1))
        best = min(abs(sum(c) - gap) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes.tolist(), n))
        assert abs(sizes[nearest(sizes, gap)].sum() - gap) == best
    many, huge = r.integers(1, 20_000, 5000), r.integers(10**8, 10**9, 200)
    assert abs(many[nearest(many, 3e6)].sum() - 3e6) <= 1
    assert abs(huge[nearest(huge, 2e10)].sum() / 2e10 - 1) < 1e-4
    assert nearest(np.array([9, 9]), 1.0).tolist() == [False, False]


def test_small_sources_come_near_their_targets(spark):
    """Ten documents a source, some very long, ids null, rows repeated under one id, one id in two sources."""
    r = np.random.default_rng(8)
    data = [(i, "x " * int(r.integers(1, 400) if i % 10 else 30_000), f"s{i % 30}", 1, "q") for i in range(300)]
    data += [(3, data[3][1], "s3", 1, "q"), (4, "x y z", "s5", 1, "q"), (None, "u v", "s6", 1, "q"), (None, "u v", "s6", 1, "q"), (None, None, "s6", 1, "q")]
    df = spark.createDataFrame(data, DDL).drop("size", "shards")
    clashing = mixed(df.withColumns({"shards": F.lit("q"), "size": F.lit(1)}), keep_columns=True)
    assert clashing.columns == [*df.columns, "shards", "size", "size", "source_size", "target", "copies", "taken", "shards"] and clashing.count() == len(data)
    got = mixed(df, keep_columns=True).collect()
    assert len(got) == len(data) and all(len(x.shards) == x.copies <= 3 for x in got)
    taken, want = Counter(), {x.source: x.target for x in got}
    for x in got:
        taken[x.source] += x.taken
    for s, w in want.items():
        least = min(x.source_size if x["copies"] == 3 else len((x.text or "").split()) or 1 for x in got if x.source == s)
        assert abs(taken[s] - w) <= max(0.01 * w, least), s
    assert len({(x.copies, tuple(x.shards)) for x in got if x.doc_id == 3}) == 1
    assert sorted(map(str, mixed(df, keep_columns=True).collect())) == sorted(map(str, got))
    assert mixture(df).count() == sum(x.copies for x in got)


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, DDL)
    got = mixed(df).collect()
    assert len(got) == len(data)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in data}
    source = {i: s for i, _, s, *_ in data}
    assert all(r["size"] == size[r.doc_id] and r.taken == r.copies * r["size"] and r.copies <= 3 and len(r.shards) == r.copies for r in got)
    names = sorted({s for s in source.values() if s is not None}, key=lambda s: s.encode()) + [None]
    total = np.array([sum(size[i] for i in size if source[i] == s) for s in names], float)
    want = targets(total, np.arange(len(names)) % 3 + 1.0, total.sum())
    taken, largest = Counter(), max(size.values())
    for r in got:
        taken[source[r.doc_id]] += r.taken
        k = names.index(source[r.doc_id])
        assert abs(r.target - want[k]) < 1e-6 and r.source_size == total[k]
    near = {s: (taken[s], float(want[k]), int(total[k])) for k, s in enumerate(names)}
    assert all(abs(t - w) <= min(largest, max(2, 0.01 * w)) for t, w, _ in near.values()), list(near.items())[-2:]
    assert sorted(map(str, mixed(df).collect())) == sorted(map(str, got))
    copies = Counter(r.doc_id for r in mixture(df).collect())
    assert mixture(df).columns == df.columns and copies == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixed(df.limit(0)).collect() == []
