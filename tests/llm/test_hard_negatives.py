import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.hard_negatives import best, grouped, hard_negatives

DDL = "vec_id long, embedding array<double>, label int, score double, id string, q int"


def brute(rows, every=5, positives=5, negatives=3):
    """All scores in Python's whole numbers."""
    one, lengths = {}, {}
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for _, v, _ in ok:
        lengths[len(v)] = lengths.get(len(v), 0) + 1
    dim = min(lengths, key=lambda d: (-lengths[d], d)) if lengths else 0
    for i, v, y in ok:
        if len(v) == dim and all(abs(x) < int((2**62 / dim) ** 0.5) for x in v):
            one[i] = min(one.get(i, (v, y)), (v, y))
    out = []
    for a, (q, label) in one.items():
        if a % every:
            continue
        scored = sorted(((-sum(x * z for x, z in zip(q, v, strict=True)), i, y) for i, (v, y) in one.items() if i != a))
        for p, pid, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [(i, -s) for s, i, y in scored if y != label and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, pid, k + 1, i, -p, s) for k, (i, s) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, parts=3, **own):
    df = spark.createDataFrame([(i, v, y, 0.0, "clash", 1) for i, v, y in rows], DDL).repartition(parts)
    got = [tuple(r) for r in hard_negatives(df, F.col("vec_id") % 5 == 0, **own).collect()]
    assert len(set(got)) == len(got)
    return sorted(got)


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, x[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("group,part", [(7, 40), (1000, 1000), (30, 100)])
def test_equals_brute_force(spark, group, part):
    rows = clustered(300, 6, group)
    want = brute(rows)
    assert len(want) > 300 and run(spark, rows, group=group, part=part) == want


def test_odd_rows_ties_and_repeats(spark):
    rows = clustered(120, 4, 2, labels=2)
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (205, [], 1), (210, [nan] * 4, 1), (215, [inf, 0.0, 0.0, 0.0], 1), (220, [None, 0.0, 0.0, 0.0], 1), (225, [0.5] * 4, None), (None, [0.5] * 4, 1), (230, [0.1] * 3, 1), (235, [0.0] * 4, 0)]
    rows += [(300 + i, [0.5] * 4, i % 2) for i in range(40)]  # equal vectors: ties by id
    rows += [(5, [0.25] * 4, 1), (5, [0.25] * 4, 1), (10, [0.75] * 4, 0), (400, [-0.5] * 4, 0), (405, [1e18] * 4, 1)]
    assert run(spark, rows, group=9, part=25) == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * 1_000_000).tolist(), i % 3) for i in range(80)]
    assert run(spark, rows, group=5, part=20) == brute(rows)


def test_small_tables(spark):
    rows = clustered(40, 5, 3)
    for some in ([], rows[1:5], rows[:1], rows[:2], [(0, [1.0], 1), (1, [0.9], 1), (2, [0.8], 2)], [(0, None, 1)]):
        assert run(spark, some, 1) == brute(some)
    lone = [(i, v, i) for i, v, _ in rows]  # no two rows of a label
    assert run(spark, lone) == []


def test_helpers():
    s = np.array([[3.0, 5.0, 5.0, 1.0, 5.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    row, col = best(s, np.array([[True, False, True, True, True], [True] * 5]), 2)
    assert list(zip(row.tolist(), col.tolist())) == [(0, 2), (0, 4), (1, 0), (1, 1)]
    plan = grouped(np.array([[0.0], [1.0], [10.0], [11.0]]), {0: 3, 1: 4, 2: 25, 3: 2}, 10)
    assert plan[0] == plan[1] == (0, 1) and plan[2][1] == 3 and plan[3] == (plan[2][0] + 3, 1)
