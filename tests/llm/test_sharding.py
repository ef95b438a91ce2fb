import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.sharding import place, sharded

DDL = "doc_id long, text string, shard string, size int"


def rows():
    r = np.random.default_rng(2)
    out = [(i, "é" * int(r.integers(0, 400)) if i % 3 else "copy of one text " * 20, "s", 1) for i in range(4000)]
    return [*out, (7, None, "s", 1), (7, None, "s", 1), (None, "", "s", 1), (5000, "x" * 30000, "s", 1)]


@pytest.mark.parametrize("n", [8, 3])
def test_law_slots_and_sizes(spark, n):
    data = rows()
    df = spark.createDataFrame(data, DDL).repartition(7)
    got = sharded(df, n).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    total, per = defaultdict(int), defaultdict(list)
    for r in got:
        total[r.shard] += r["size"]
        per[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(total) == set(range(n)) and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(total.values()) - min(total.values()) <= 2 * 30001
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= n
    full = sharded(df, n, keep_columns=True)
    assert full.columns == ["doc_id", "text", "size", "shard", "slot"] and full.count() == len(data)


def test_empty_and_place(spark):
    assert sharded(spark.createDataFrame([], DDL)).collect() == []
    cuts = [(0, -5), (3, -(2**63)), (3, 10), (9, 0)]
    h, i = np.array([-1, 0, 0, 3, 3, 3, 9, 10]), np.array([0, -6, -5, 1, 9, 10, -1, 0])
    assert list(place(h, i, cuts)) == [0, 0, 1, 2, 2, 3, 3, 4]
