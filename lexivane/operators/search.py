"""Search over stored postings and vectors: a batch of queries is a table, joined with the postings of its terms only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text as tx
from . import ranking

#: Query terms that may be broadcast, and queries whose vectors are compared at once.
TERMS, AT_ONCE = 100_000, 256
#: Candidates of a query by BM25, and as many by cosine: this many times the results asked for.
CANDIDATES = 3


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ("path",), distinct: bool = False) -> DataFrame:
    """id, keep, term, tf, dl, in order of the term: a reader that wants a few terms skips the other row groups."""
    words = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    words = F.array_distinct(words) if distinct else words
    base = chunks.select(F.col(id_col).alias("id"), *keep, words.alias("w")).select("id", *keep, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    counts = base.groupBy("id", *keep, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ("path",), distinct: bool = False) -> DataFrame:
    """id, keep, dl: chunks without tokens have 0, and count in the statistics."""
    words = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    return chunks.select(F.col(id_col).alias("id"), *keep, F.size(F.array_distinct(words) if distinct else words).cast("long").alias("dl"))


def query_words(queries: DataFrame) -> DataFrame:
    """queries: qid, query. qid, term, times."""
    words = tx.tokens(F.col("query"))
    return queries.select("qid", F.explode(words).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def _hits(posts: DataFrame, words: DataFrame) -> DataFrame:
    """The postings of the queries' terms."""
    terms = words.select("term").distinct()
    few = [r["term"] for r in terms.limit(201).collect()]  # a few terms are a filter that Parquet's row groups answer
    if len(few) <= 200:
        return posts.where(F.col("term").isin(few))
    return posts.join(F.broadcast(terms) if terms.count() <= TERMS else terms, "term")


def weights(posts: DataFrame, sizes: DataFrame, words: DataFrame) -> DataFrame:
    """term, idf, avgdl of the queries' terms that some chunk has."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    return df.join(F.broadcast(one)).select("term", scoring.idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")


def bm25(posts: DataFrame, sizes: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """qid, id, bm25: the best k of each query, by score, then id."""
    words = query_words(queries)
    hits = _hits(posts, words)
    told = weights(hits, sizes, words)
    rows = hits.join(told, "term").join(words, "term")
    part = scoring.bm25_term(F.col("idf") * F.col("times"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    out = rows.groupBy("qid", "id").agg(F.sum(part).alias("bm25")).where("bm25 > 0")
    return out if k is None else best(out, "bm25", k)


def best(rows: DataFrame, score: str, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round(score, 9).desc(), "id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def cosine(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors: id, embedding; queries: qid, vector. qid, id, cos: the best k of each query.

    Queries are taken AT_ONCE: their vectors go to the tasks, each of which returns its own best k.
    """
    rows = queries.select("qid", "vector").orderBy("qid")
    out = None
    block: list = []

    def compared(part: list) -> DataFrame:
        ids = np.array([r["qid"] for r in part])
        probe = np.array([r["vector"] for r in part], dtype=float)
        probe /= np.maximum(np.linalg.norm(probe, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                own = np.stack(b["embedding"].to_numpy()).astype(float)
                size = np.linalg.norm(own, axis=1, keepdims=True)
                cos = probe @ np.divide(own, size, out=np.zeros_like(own), where=size > 0).T
                id_ = b["id"].to_numpy()
                for q, line in zip(ids.tolist(), cos):
                    line_ = np.round(line, 9)
                    by = np.lexsort((id_, -line_))[:k]
                    yield pd.DataFrame({"qid": q, "id": id_[by], "cos": line[by]})

        kinds = dict(vectors.dtypes)
        return vectors.select("id", "embedding").mapInPandas(run, f"qid long, id {kinds['id']}, cos double")

    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == AT_ONCE:
            out = compared(block) if out is None else out.union(compared(block))
            block = []
    if block or out is None:
        part = compared(block) if block else vectors.select(F.lit(0).cast("long").alias("qid"), "id", F.lit(0.0).alias("cos")).where("false")
        out = part if out is None else out.union(part)
    return best(out, "cos", k)


def _near(term: Column, low: Column, tokens: Column) -> Column:
    """A text has a term if it holds it, or a token of four and more characters that the term begins with."""
    starts = F.transform(F.sequence(F.lit(4), F.greatest(F.length(term), F.lit(4))), lambda i: F.substring(term, F.lit(1), i))
    return F.contains(low, term) | ((F.length(term) >= 4) & F.arrays_overlap(tokens, starts))


def hybrid(chunks: DataFrame, posts: DataFrame, sizes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, by: str = "structured", min_score: float = 0.15, blend: tuple[float, float] = ranking.WEIGHTS) -> DataFrame:
    """queries: qid, query, vector. qid, id, rank, score, semantic, structured: the documentation plan over each query's candidates.

    chunks: id, text. Texts are read for candidates only: the best CANDIDATES * k by BM25, and by cosine.
    """
    words = query_words(queries)
    hits = _hits(posts, words)
    told = weights(hits, sizes, words)
    lexical = bm25(posts, sizes, queries, CANDIDATES * k).select("qid", "id", scoring.sigmoid(F.col("bm25")).alias("b"))
    near = cosine(vectors, queries, CANDIDATES * k)
    found = lexical.join(near.select("qid", "id"), ["qid", "id"], "full")
    own = queries.select("qid", "query", "vector")
    rows = found.join(F.broadcast(own), "qid").join(vectors.select("id", "embedding"), "id", "left").join(chunks.select("id", "text"), "id")
    mid = Window.partitionBy("qid")  # a query's terms
    idf = words.join(told, "term").select("qid", "term", "idf", F.median("idf").over(mid).alias("mid")).where("idf >= mid")
    salient = idf.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("salient"), F.sum("idf").alias("whole"))
    rows = rows.join(F.broadcast(salient), "qid", "left")
    low, tokens = F.lower(F.coalesce("text", F.lit(""))), tx.tokens(F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"low": low, "tokens": tokens, "asked": F.array_distinct(tx.tokens(F.col("query"))), "phrase_": F.lower(F.trim("query"))})
    got = F.aggregate(F.filter("salient", lambda s: _near(s["term"], F.col("low"), F.col("tokens"))), F.lit(0.0), lambda a, s: a + s["idf"])
    share = F.coalesce(got / F.col("whole"), F.lit(1.0))
    coverage = F.size(F.filter("asked", lambda w: F.contains(F.col("low"), w))) / F.greatest(F.size("asked"), F.lit(1))
    cos = F.coalesce(scoring.cosine(F.col("vector"), F.col("embedding")), F.lit(0.0))
    rows = rows.select("qid", "id", F.coalesce("b", F.lit(0.0)).alias("b"), cos.alias("cos"), share.alias("share"), F.when(F.col("whole").isNotNull(), 0.1 * share).otherwise(0.0).alias("boost"), coverage.alias("coverage"), F.contains("low", F.col("phrase_")).alias("exact"))
    phrase = F.when(F.col("exact"), 0.5).when(F.col("coverage") >= 0.8, 0.2).when(F.col("coverage") >= 0.6, 0.1).otherwise(0.0)
    blended = (blend[0] * F.col("cos") + blend[1] * F.col("b") + F.col("phrase") + F.col("boost")) * F.greatest(F.lit(0.72), 1 - 0.16 * (1 - F.col("share")))
    rows = rows.withColumn("phrase", phrase).withColumn("score", blended).where((F.col("score") >= min_score) | (F.col("b") > 0.3) | (F.col("phrase") >= 0.2))
    structured = scoring.clamp(blend[1] * F.col("b") + F.least(F.lit(0.2), 0.15 * F.col("coverage")))
    rows = rows.select("qid", "id", "score", scoring.semantic_share(F.col("cos")).alias("semantic"), structured.alias("structured"))
    order = [F.round(c, 9).desc() for c in ranking.ORDERS[by]]
    w = Window.partitionBy("qid").orderBy(*order, "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
