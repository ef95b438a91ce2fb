"""Sentiment by a lexicon that is learned from labelled texts.

A word's weight is the difference of its pointwise mutual information with the positive and the negative texts that it is
in, over ``scale`` and within [-1, 1]. In a text, a word within three words after a negator counts the other way, at half
its weight; one right after an intensifier counts half as much again, after a downtoner half as much. The score is the
sum of these over the sum of their sizes, in [-1, 1]; 0 where no word is known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel import div

NEGATORS = ("not", "no", "never", "without", "hardly", "neither", "nor")
INTENSIFIERS = ("very", "really", "extremely", "highly", "so")
DOWNTONERS = ("slightly", "somewhat", "rather", "barely", "fairly")
#: Words after a negator that it turns round, and what is left of their weight.
SCOPE, TURNED, MORE, LESS = 3, -0.5, 1.5, 0.5
#: So many words of a lexicon are broadcast, a few MB.
COMMON = 50_000
#: What a word is: letters of any script, in lower case.
SPLIT = r"[^\p{L}]+"


def _words(text: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), SPLIT), lambda w: w != "")


def learned(texts: DataFrame, text: str, label: str, least: int = 5, smoothing: float = 0.5, scale: float = 4.0) -> DataFrame:
    """(word, n, weight) of words in ``least`` texts or more; ``label`` is 1 for positive texts, 0 for negative ones, and others don't count.

    A text counts a word once. ``smoothing`` texts are added to each count of a word. Counts are combined before the
    shuffle, so a word that most texts share is no hot key.
    """
    rows = texts.select(F.col(label).cast("int").alias("__y"), F.array_distinct(_words(text)).alias("__w")).where("__y IN (0, 1)")
    all_ = rows.agg(F.sum("__y").alias("__p"), F.sum(1 - F.col("__y")).alias("__q"))
    per = rows.select("__y", F.explode("__w").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("__y").alias("__a"), F.sum(1 - F.col("__y")).alias("__b")).where(F.col("n") >= least)
    pmi = F.log2((F.col("__a") + smoothing) / (F.col("__p") + 2 * smoothing)) - F.log2((F.col("__b") + smoothing) / (F.col("__q") + 2 * smoothing))
    return per.join(F.broadcast(all_), how="cross").select("word", "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pmi / scale)).alias("weight"))  # one row


def scored(df: DataFrame, key: str, text: str, lexicon: DataFrame, negators: Sequence[str] = NEGATORS, more: Sequence[str] = INTENSIFIERS, less: Sequence[str] = DOWNTONERS) -> DataFrame:
    """(key, words, sentiment) of every row, ``key`` being unique and the lexicon's words distinct: how many of its words the lexicon has, and the score.

    The ``COMMON`` words that most texts have (by the lexicon's ``n``, if it has that) are broadcast, and their uses are
    added up text by text where they are read. The others meet the lexicon by a join, after equal uses of a word in a
    text have been added up.
    """
    kinds = {1: tuple(negators), 2: tuple(more), 3: tuple(less)}
    mark = lambda w: F.coalesce(*[F.when(w.isin(*some), k) for k, some in kinds.items()], F.lit(0))
    marks = F.when(F.arrays_overlap("__w", F.array(*[F.lit(w) for some in kinds.values() for w in some])), F.transform("__w", mark))
    back = lambda i, k: F.coalesce(F.get("__m", i - k), F.lit(0))
    turned = lambda i: reduce(or_, [back(i, k) == 1 for k in range(1, SCOPE + 1)])
    factor = lambda i: F.when(turned(i), TURNED).otherwise(1.0) * F.when(back(i, 1) == 2, MORE).when(back(i, 1) == 3, LESS).otherwise(1.0)
    rows = df.select(F.col(key).alias("__k"), _words(text).alias("__w")).withColumn("__m", marks)
    rows = rows.withColumn("__f", F.when(F.col("__m").isNotNull(), F.transform("__w", lambda _, i: factor(i))))
    rows = rows.select("__k", "__f", F.posexplode("__w").alias("__i", "word")).select("__k", "word", F.coalesce(F.get("__f", F.col("__i")), F.lit(1.0)).alias("f"))

    known = lexicon.select("word", F.col("weight").alias("__weight"), F.lit(True).alias("__hit"))
    common = lexicon.orderBy(*([F.desc("n")] if "n" in lexicon.columns else []), "word").limit(COMMON).select("word", "weight", F.lit(True).alias("__common"))
    used = rows.join(F.broadcast(common), "word", "left")
    w = F.col("weight")
    used = used.groupBy("__k", F.when(F.col("__common").isNull(), F.col("word")).alias("word")).agg(F.count("__common").alias("h"), F.sum(F.col("f") * w).alias("s"), F.sum(F.abs("f") * F.abs(w)).alias("t"), F.count("*").alias("c"), F.sum("f").alias("f"), F.sum(F.abs("f")).alias("g"))
    # what is known of a text goes with a word that no lexicon has, another one for each text, or all would meet in one task
    used = used.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), F.col("__k").cast("string"))))
    hit = used.join(known, "word", "left").where("h > 0 OR __hit")
    w, or_else = F.col("__weight"), lambda c, x: F.when(F.col("h") > 0, F.col(c)).otherwise(x)
    per = hit.groupBy("__k").agg(F.sum("c").alias("words"), F.sum(or_else("s", F.col("f") * w)).alias("__s"), F.sum(or_else("t", F.col("g") * F.abs(w))).alias("__t"))
    out = df.select(F.col(key)).join(per, F.col(key) == F.col("__k"), "left")
    return out.select(key, F.coalesce("words", F.lit(0)).alias("words"), F.coalesce(div("__s", "__t"), F.lit(0.0)).alias("sentiment"))


def accuracy(scores: DataFrame, sentiment: str, label: str, limit: float = 0.0) -> DataFrame:
    """(n, accuracy, precision, recall) of positive calls, those whose score is over ``limit``."""
    called, good = (F.col(sentiment) > limit).cast("int"), F.col(label).cast("int")
    d = scores.where(good.isin(0, 1))
    both = F.sum(called * good)
    return d.agg(F.count("*").alias("n"), F.avg((called == good).cast("double")).alias("accuracy"), div(both.cast("double"), F.sum(called)).alias("precision"), div(both.cast("double"), F.sum(good)).alias("recall"))
