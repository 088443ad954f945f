"""Fusion, match scales, comparators and the documents' hybrid score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from . import lexical

#: Weights of the documentation module: cosine and BM25.
WEIGHTS = (0.62, 0.33)
#: Criteria of each order, the first first.
ORDERS = {"structured": ["structured", "semantic", "score"], "semantic": ["semantic", "structured", "score"], "combined": ["score"]}


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, probe: list[float], top_k: int = 10, min_score: float = 0.15, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """id, cos, b, phrase, coverage, score, semantic, structured of documents that pass the score or lexical bar.

    docs: doc_id, text; vectors: vec_id, embedding. Only the top 3 * top_k BM25 scores count.
    """
    b = lexical.capped(lexical.bm25(docs, query), top_k)
    words = sorted(set(lexical._tokens(query)))
    disc = lexical.discriminative(docs, query)
    vec = vectors.select(F.col("vec_id").alias("id"), scoring.cosine(F.col("embedding"), F.array(*(F.lit(x) for x in probe))).alias("cos"))
    low = docs.select(F.col("doc_id").alias("id"), scoring.phrase_boost(F.col("text"), query.lower(), words).alias("phrase"), scoring.coverage(F.col("text"), words).alias("coverage"))
    df = low.join(vec, "id", "left").join(b, "id", "left").join(disc.withColumnRenamed("coverage", "share"), "id")
    df = df.select("id", F.coalesce("cos", F.lit(0.0)).alias("cos"), F.coalesce("b", F.lit(0.0)).alias("b"), "phrase", "coverage", "boost", "penalty")
    score = (weights[0] * F.col("cos") + weights[1] * F.col("b") + F.col("phrase") + F.col("boost")) * F.col("penalty")
    df = df.withColumn("score", score).where((F.col("score") >= min_score) | (F.col("b") > 0.3) | (F.col("phrase") >= 0.2))
    structured = scoring.clamp(weights[1] * F.col("b") + F.least(F.lit(0.2), 0.15 * F.col("coverage")))
    return df.withColumn("semantic", scoring.semantic_share(F.col("cos"))).withColumn("structured", structured)


def fused(results: DataFrame, exact: DataFrame, factor: float = 1.5) -> DataFrame:
    """results: id, score, structured; exact: id of documents that hold the literal. Their scores are raised."""
    hit = F.broadcast(exact.select("id", F.lit(True).alias("_exact")))  # at most the exact track's file limit
    out = results.join(hit, "id", "left")
    up = F.when(F.col("_exact"), factor).otherwise(1.0)
    return out.select("id", (F.col("score") * up).alias("score"), scoring.clamp(F.col("structured") * up).alias("structured"), F.coalesce("_exact", F.lit(False)).alias("exact"))


def ranked(results: DataFrame, by: str, k: int) -> DataFrame:
    """Adds rank, from 1, by one of three orders; equal up to nine places goes to the next criterion, at last the id."""
    keys = ORDERS[by]
    top = results.orderBy(*(F.round(c, 9).desc() for c in keys), "id").limit(k)
    from pyspark.sql import Window

    w = Window.orderBy(*(F.round(c, 9).desc() for c in keys), "id")  # over k rows
    return top.withColumn("rank", F.row_number().over(w))
