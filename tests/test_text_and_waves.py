"""The learned lexicon, and wavelets with mirrored ends."""

import math
import re

import numpy as np
import pytest

from tidemark.operators import alternative, lexicon


def texts(n, seed):
    rng = np.random.default_rng(seed)
    good, bad, both = ["fine", "bright", "gains"], ["dull", "slump", "losses"], ["stock", "market", "report", "today"]
    out = []
    for i in range(n):
        y = int(rng.integers(0, 2))
        words = [str(rng.choice((good if y else bad) if rng.random() < 0.5 else both)) for _ in range(int(rng.integers(3, 12)))]
        if rng.random() < 0.3:  # the other side's word, turned round
            words += ["not", "very", str(rng.choice(bad if y else good))]
        out.append((i, " ".join(words), y))
    return out


def test_scores_of_known_weights(spark):
    known = spark.createDataFrame([("fine", 9, 0.5), ("dull", 9, -1.0)], "word string, n long, weight double")
    df = spark.createDataFrame([(0, "Fine, fine!"), (1, "not fine"), (2, "very fine but dull"), (3, "never one two dull"), (4, "not a b c dull"), (5, None), (6, "nothing"), (7, "slightly dull fine"), (8, "fine" + " x" * 50_000)], "k long, text string")
    got = {r.k: (r.words, r.sentiment) for r in lexicon.scored(df, "k", "text", known).collect()}
    want = {0: (2, 1.0), 1: (1, -1.0), 2: (2, (0.75 - 1) / 1.75), 3: (1, 1.0), 4: (1, -1.0), 5: (0, 0.0), 6: (0, 0.0), 7: (2, 0.0), 8: (1, 1.0)}
    assert got.keys() == want.keys() and all(got[k][0] == n and math.isclose(got[k][1], s, abs_tol=1e-12) for k, (n, s) in want.items())


@pytest.mark.parametrize("common", [0, 2, 50_000])
def test_common_words_are_broadcast_and_the_others_joined(spark, monkeypatch, common):
    monkeypatch.setattr(lexicon, "COMMON", common)
    known = spark.createDataFrame([("good", 9, 0.5), ("bad", 8, -1.0), ("fine", 7, 0.25), ("odd", 6, None)], "word string, n long, weight double")
    df = spark.createDataFrame([(1, "good not so good, never"), (2, "bad bad odd unknown fine"), (3, "unknown"), (4, None), (5, "fine, very fine")], "k int, text string")
    scores = lexicon.scored(df, "k", "text", known)
    got = {r.k: (r.words, round(r.sentiment, 9)) for r in scores.collect()}
    turned = -0.5 * 1.5 * 0.5
    assert got == {1: (2, round((0.5 + turned) / (0.5 - turned), 9)), 2: (4, round(-1.75 / 2.25, 9)), 3: (0, 0.0), 4: (0, 0.0), 5: (2, 1.0)}


def test_learned_weights_and_held_out_accuracy(spark):
    rows = texts(600, 1)
    df = spark.createDataFrame(rows, "k long, text string, y int").repartition(3)
    train, test = df.where("k % 5 <> 0"), df.where("k % 5 = 0")
    lex = lexicon.learned(train, "text", "y")
    weights = {r.word: (r.n, r.weight) for r in lex.collect()}
    part = [r for r in rows if r[0] % 5]
    for w, (n, weight) in weights.items():
        has = [y for _, t, y in part if w in re.split(r"\W+", t)]
        p, q, a = sum(y for *_, y in part), sum(1 - y for *_, y in part), sum(has)
        want = math.log2((a + 0.5) / (p + 1)) - math.log2((len(has) - a + 0.5) / (q + 1))
        assert n == len(has) and math.isclose(weight, max(-1, min(1, want / 4)), abs_tol=1e-12)
    assert weights["fine"][1] > 0.1 > abs(weights["market"][1]) and weights["slump"][1] < -0.1
    told = lexicon.accuracy(lexicon.scored(test, "k", "text", lex).join(test.select("k", "y"), "k"), "sentiment", "y").first()
    assert told.n == 120 and told.accuracy > 0.9
    assert lexicon.learned(train.limit(0), "text", "y").count() == 0


def mirrored(x, e):
    e %= 2 * len(x)
    return x[e] if e < len(x) else x[2 * len(x) - 1 - e]


def parted(x, low, high):
    n, taps = len(x), len(low)
    k = range((n + taps - 1) // 2)
    return [np.array([sum(f[j] * mirrored(x, 2 * i + 1 - j) for j in range(taps)) for i in k]) for f in (low, high)]


@pytest.mark.parametrize("rows", [1_000_000, 60])
def test_bands_with_mirrored_ends(spark, rows):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=301), "b": rng.normal(size=40), "c": rng.normal(size=3), "d": rng.normal(size=1)}
    df = spark.createDataFrame([(k, 10 * i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("e", 0, None), ("e", 1, 1.0)], "k string, t long, x double").repartition(4)
    data["e"] = np.array([0.0, 1.0])
    h = alternative.daubechies(4)
    low, high = h[::-1], h * (-1.0) ** (np.arange(8) + 1)
    got = {n: {} for n in ("x_D1", "x_D2", "x_D3", "x_A3")}
    for n, band in alternative.wavelet_bands(df, ["k"], "t", "x", rows=rows):
        for r in band.collect():
            got[n].setdefault(r.k, {})[r.i] = r.x
    for k, x in data.items():
        now = x
        for level in (1, 2, 3):
            a, d = parted(now, low, high)
            assert len(a) == (len(now) + 7) // 2
            assert np.allclose([got[f"x_D{level}"][k][i] for i in range(len(d))], d, atol=1e-9), (k, level)
            # the inverse from both bands gives the values back
            up = np.zeros(2 * len(a) + 8)
            for i in range(len(a)):
                up[2 * i : 2 * i + 8] += a[i] * low[::-1] + d[i] * high[::-1]
            assert np.allclose(up[6 : 6 + len(now)], now, atol=1e-9)
            now = a
        assert np.allclose([got["x_A3"][k][i] for i in range(len(now))], now, atol=1e-9)
    means = {r.k: r for r in alternative.wavelet(df, ["k"], "t", "x", rows=rows).collect()}
    assert set(means) == set(data) and all(math.isclose(means[k]["x_D1"], np.mean(list(got["x_D1"][k].values())), abs_tol=1e-12) for k in data)
