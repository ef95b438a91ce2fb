import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidemark.llm.mixing import mixed

from .test_decontaminate import brute as contaminated_by
from .test_jaccard_join import brute as components_by

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0.5 * before <= docs.count() <= before


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    vocab = [f"v{i}" for i in range(900)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(40) for _ in range(3)]
    rows = []
    for i in range(160):
        own = say(r.randint(30, 120))
        if i % 9 == 0:
            own[5:5] = items[i % 3][:20]
        rows.append(own)
        if i % 8 == 0:
            rows += [own, [*own[:-1], "changed"]]
        if i % 5 == 0:
            rows.append(["junk", "spam"] * r.randint(10, 60))
    data = [(k, " ".join(w), "en", f"s{k % 3}", len(" ".join(w))) for k, w in enumerate(rows)]
    spark.createDataFrame(data, DDL).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(w[0] != "junk"), 0) for k, w in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, data, [(i, " ".join(x)) for i, x in enumerate(items)]


def test_stages_equal_brute_force(spark, folder):
    """Each stage on its own input; scores of the classifier, not SQL, by the labels that it is taught."""
    path, data, items = folder
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    docs = stage["quality"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    text = {i: t for i, t, *_ in data}
    assert ids(docs) == [i for i, t in text.items() if not t.startswith("junk")]
    docs = stage["near_duplicates"](spark, docs, path)
    left = [i for i, t in text.items() if not t.startswith("junk")]
    left = sorted({c for _, _, c in components_by([(i, text[i]) for i in left], 5, 8, 10)})
    assert ids(docs) == left
    docs = stage["decontamination"](spark, docs, path)
    left = sorted(set(left) - {d for d, *_ in contaminated_by([(i, text[i]) for i in left], items, 5)})
    assert ids(docs) == left and len(left) < 150
    mix = stage["mixing"](spark, docs, path)
    want = Counter({r.doc_id: r.copies for r in mixed(docs).collect() if r.copies})
    assert Counter(ids(mix)) == want and mix.columns == docs.columns and max(want.values()) <= 3
    got = corpus_pipeline.run(spark, path)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert Counter(r.doc_id for r in rows) == want and all(r.text == text[r.doc_id] for r in rows)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += len(r.text.encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 2 * max(len(t) + 1 for t in text.values())


def test_stages_of_empty_tables_and_odd_rows(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, 0), (1, "", "en", None, 0), (2, "x " * 60_000, "en", "s1", 120_000)], DDL)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
        got = stage(spark, odd, path)
        assert got.columns[:5] == docs.columns
        if name in ("decontamination", "sharding"):
            assert got.count() == 4
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"]
        clash = docs.limit(20).selectExpr("*", "doc_id as id", "text as shards", "1 as __x", "lang as pseudo")
        assert set(stage(spark, clash, path).columns) >= set(clash.columns)
