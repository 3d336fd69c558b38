"""The registered queries of this package.  Their SQL is in oracles.py."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import (
    collocations, decontamination, factorisation, jaccard_groups, mixing, quality_rules, sharding, simhash,
    substring_dedup, token_counts, toxicity, url_filter, whitening,
)
from palisade.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# where the public tokenizers lie on every machine
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
# fixed values: the rules of the URL query, and the sites whose pages make up its list
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
LISTED_SITES = ("casino-win", "cheap-pills", "free-bets", "spam-farm", "adult-x", "ads-track")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), factorisation.in_fold(F.col("doc_id"), 4, 2)
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    return factorisation.scores(docs, factorisation.trained(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), factorisation.in_fold(F.col("doc_id"), 5, 0)
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.scores(docs, toxicity.trained(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_terms", "n_misspelled", "n_quoted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.byte_shards(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.merged_counts(
        _table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = quality_rules.judged_by_grams(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", *(F.col(f"`rules of row`.{c}").alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host(F.col("url")).rlike("(^|[.])(" + "|".join(LISTED_SITES) + ")[.]"))
    return url_filter.verdicts(pages, listed, RULES)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.classes(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash": op10_simhash,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}
