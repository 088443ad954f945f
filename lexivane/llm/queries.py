"""One query an operator, with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, ngram_join, quality_crf, quality_rules, sentencepieces, token_counts, token_store, url_filters, warc
from .common import read


def op1_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_crf.classify(docs, quality_crf.learn(docs, read(spark, sf_dir, "labels")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("url_key"), bad.alias("bad"))
    return url_filters.url_filter(read(spark, sf_dir, "pages"), labels)


def vocabulary(name: str) -> str:
    """A public vocabulary's place; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_steps=False).drop("steps")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepieces": op1_sentencepieces,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_token_store": op4_token_store,
    "op5_ngram_join": op5_ngram_join,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filters": op10_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op6_warc": warc.ORACLE,
}
