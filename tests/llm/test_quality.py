import random

from tidemark.llm.quality import accepted, quality_scores


def data(n=900, seed=0):
    r = random.Random(seed)
    vocab, rude = [f"w{i}" for i in range(300)], ["vile", "scum"]
    docs, labels = [], []
    for i in range(n):
        words, kind = [r.choice(vocab) for _ in range(r.randint(20, 200))], i % 4
        if kind == 1:
            words = [w for w in words[:20] for _ in range(5)]
        if kind == 2:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(rude))
        docs.append((i, " ".join(words), r.choice(["en", None]), f"s{i % 5}", len(words), "clash"))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    return docs, labels


DDL = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_held_out_accuracy(spark):
    docs, labels = data()
    df = spark.createDataFrame(docs, DDL)
    known = spark.createDataFrame(labels[:500] + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality_scores(df, known, exchange=50).collect()}
    right = sum(got[i] == (q == 1 and t == 0) for i, q, t in labels[500:])
    assert right >= 0.9 * len(labels[500:])
    kept = accepted(df, known, exchange=50)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_edges(spark):
    docs, labels = data(40)
    df = spark.createDataFrame([*docs, (99, None, None, None, None, None), (None, "", "en", "s", 1, "c")], DDL)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep and r.score == 1 for r in quality_scores(df, none).collect())
    some = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality_scores(df, some, rounds=1).count() == 42 and quality_scores(df.limit(0), some).count() == 0
