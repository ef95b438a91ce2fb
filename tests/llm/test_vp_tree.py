import numpy as np

from tidemark.llm import vp_tree
from tidemark.llm.vp_tree import neighbours

DDL = "vec_id long, embedding array<float>, label int, score double"


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        rank = sorted((float(v), i) for v, i in zip(d, ids, strict=True) if i != q)[:k]
        out[q] = rank
    return out


def data(n=3000, dim=12):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[100:900] = x[99]
    return list(range(n)), x


def test_factor_one_is_exact(spark):
    ids, x = data()
    rows = [(i, v.tolist(), 1, 0.0) for i, v in zip(ids, x, strict=True)]
    rows += [(9000, None, 1, 0.0), (9100, [0.0] * 12, 1, 0.0), (9200, [float("nan")] * 12, 1, 0.0), (9300, [None] * 12, 1, 0.0), (9400, [1.0], 1, 0.0), (9500, [float("inf")] * 12, 1, 0.0), (None, x[0].tolist(), 1, 0.0), (5, x[5].tolist(), 1, 0.0)]
    df = spark.createDataFrame(rows, DDL).repartition(4)
    got = {}
    for r in neighbours(df, df.where("vec_id % 100 = 0"), 10, factor=1.0, shard=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(ids, x.astype(float), [i for i in ids if i % 100 == 0], 10)
    assert set(got) == set(want)
    for q, rank in want.items():
        own = sorted(got[q])
        assert [i for *_, i in own] == [i for _, i in rank] and np.allclose([v for _, v, _ in own], [v for v, _ in rank], rtol=1e-12, atol=0)


def test_relaxed_recall_and_small(spark):
    ids, x = data()
    df = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in zip(ids, x, strict=True)], DDL)
    want = brute(ids, x.astype(float), [i for i in ids if i % 100 == 0], 10)
    hit = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in neighbours(df, df.where("vec_id % 100 = 0"), 10, shard=500).collect())
    assert hit >= 0.9 * sum(map(len, want.values()))
    three = df.where("vec_id < 3")
    assert neighbours(three, three, 10).count() == 6
    assert neighbours(df.limit(0), df.limit(0), 10).count() == 0


def test_recall_in_few_dimensions_over_several_regions(spark):
    r = np.random.default_rng(5)
    for dim in (4, 8):
        x = r.normal(size=(6000, dim)).astype(np.float32)
        ids = list(range(len(x)))
        df = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in zip(ids, x, strict=True)], DDL)
        want = brute(ids, x.astype(float), ids[::60], 10)
        # 6000 // (4 * 300) regions, and about 20 shards
        hit = sum(w.vec_id in {i for _, i in want[w.query_id]} for w in neighbours(df, df.where("vec_id % 60 = 0"), 10, shard=300).collect())
        assert hit >= 0.97 * sum(map(len, want.values())), (dim, hit)


def test_queries_in_parts_repeated_ids_and_very_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(vp_tree, "QUERIES", 7)
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 5)).astype(np.float32)
    rows = [(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)] + [(3, (x[3] + 50).tolist(), 1, 0.0)]  # the lesser vector of id 3 counts
    df = spark.createDataFrame(rows, DDL).repartition(3)
    asked = list(range(0, 400, 4)) + [3]
    got = {}
    for w in neighbours(df, df.where("vec_id % 4 = 0 or vec_id = 3"), 5, factor=1.0, shard=60).collect():
        got.setdefault(w.query_id, []).append((w.rank, w.vec_id))
    want = brute(list(range(400)), x.astype(float), asked, 5)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    long = spark.createDataFrame([(i, r.normal(size=20_000).tolist(), 1, 0.0) for i in range(6)], "vec_id long, embedding array<double>, label int, score double")
    assert neighbours(long, long, 10).count() == 30


def test_recall_on_dense_cores_with_halos(spark):
    """Data of mixed density, on which a factor of 1.5 loses half of what the halos' queries should find."""
    r = np.random.default_rng(7)
    for dim in (16, 64):
        centres = r.normal(size=(40, dim)) * 3
        x = np.concatenate([centres[r.integers(0, 40, n)] + s * r.normal(size=(n, dim)) for n, s in ((4000, 0.1), (2000, 1.0))]).astype(np.float32)
        ids = list(range(len(x)))
        df = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in zip(ids, x, strict=True)], DDL)
        want = brute(ids, x.astype(float), ids[::60], 10)
        hit = {q: 0 for q in want}
        for w in neighbours(df, df.where("vec_id % 60 = 0"), 10, shard=300).collect():
            hit[w.query_id] += w.vec_id in {i for _, i in want[w.query_id]}
        assert min(hit.values()) == 10, dim
