"""The queries of this subpackage, with production parameters over whole tables, and their SQL where it can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fill_middle, hard_negatives
from .decontaminate import contaminated
from .jaccard_join import jaccard_components
from .language import languages
from .license_scan import licensed
from .mixing import mixed
from .quality import quality_scores
from .sharding import sharded
from .suffix_dedup import deduplicated
from .token_store import stored
from .vp_tree import neighbours

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Of a public tokenizer's file: in ``folder``, or in the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_format.conversations_from_rows(chat_format.with_special(table(spark, sf_dir, "conversations")))
    return chat_format.digests(chat_format.formatted(chat_format.canonical_turns(records)))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: fifty ids of a source make a folder, and the first of them is its licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 50).cast("string"), name)
    return licensed(docs.select("doc_id", "text", path.alias("path")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), length=50)


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), shards=8)


def op11_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=1))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_vp_tree_neighbours, op2_ngram_jaccard_join, op3_chat_format, op4_token_store, op5_source_mix, op6_decontamination, op7_quality, op8_license_scan, op9_suffix_dedup, op10_sampled_splitters, op11_language_profiles, op12_fill_in_middle, op13_hard_negatives)}
ORACLE: dict[str, str] = {"op3_chat_format": chat_format.ORACLE, "op12_fill_in_middle": fill_middle.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
