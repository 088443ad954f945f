"""Corpus pipeline: five stages over documents, each writing a Parquet table that the next one reads.

Defined cases are those of the stages' operators: null and empty texts and very long ones go through every stage, repeated rows are
rows of their own until the join keeps one of them, columns of any names come through up to the last stage, empty tables stay empty, and
without labels the classifier keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexivane.llm import decontamination, ngram_join, quality_crf, quality_rules, sentencepieces
from lexivane.llm.common import read, written
from lexivane.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half go."""
    return quality_crf.keep_good(docs, quality_crf.learn(docs, read(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays: five-word shingles at Jaccard 0.8."""
    return ngram_join.keep_one(docs, n=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the documents that are left."""
    return sentencepieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", pieces),
]

#: The classifier, templates and pieces have no SQL form; tests hold run() against a version in plain Python that shares the learned classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
