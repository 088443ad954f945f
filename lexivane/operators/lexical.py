"""Postings, corpus statistics and lexical scores as joins and aggregations."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text as tx


def postings(docs: DataFrame, id_col: str, text_col: str, distinct: bool = False) -> DataFrame:
    """id, term, tf."""
    words = tx.tokens(F.col(text_col))
    words = F.array_distinct(words) if distinct else words
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, id_col: str, text_col: str, distinct: bool = False) -> DataFrame:
    """id, dl: documents without tokens have 0."""
    words = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.size(F.array_distinct(words) if distinct else words).cast("long").alias("dl"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """n, avgdl: one row."""
    return dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """id, bm25 of documents with a query term; a term that the query repeats counts again.

    One pass over the texts: only the counts of the query's terms leave it, and the statistics are
    one row and one row a query term.
    """
    terms = Counter(_tokens(query))
    words = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    words = F.array_distinct(words) if distinct else words
    wanted = F.filter("words", lambda t: t.isin(list(terms)))
    base = docs.select(F.col(id_col).alias("id"), words.alias("words")).select("id", F.size("words").cast("long").alias("dl"), wanted.alias("hits"))
    posts = base.where(F.size("hits") > 0).select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    times = F.create_map(*(F.lit(x) for kv in terms.items() for x in kv)) if terms else F.lit(None)
    one = corpus_stats(base)  # a single row
    weights = df.join(F.broadcast(one)).select("term", "avgdl", (scoring.idf(F.col("n"), F.col("df")) * F.element_at(times, F.col("term"))).alias("w"))
    scored = posts.join(F.broadcast(weights), "term")  # a row a query term
    part = scoring.bm25_term(F.col("w"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("id").agg(F.sum(part).alias("bm25")).where("bm25 > 0")


def _tokens(query: str) -> list[str]:
    import re

    return re.findall(r"\w{2,}", query.lower(), re.ASCII)


def capped(scores: DataFrame, top_k: int, factor: int = 3) -> DataFrame:
    """id, b: normalised score of the best factor * top_k, 0 for the others."""
    best = scores.orderBy(F.desc("bm25"), "id").limit(factor * top_k).select("id", scoring.sigmoid(F.col("bm25")).alias("b"))
    return scores.select("id").join(F.broadcast(best), "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("b"))


def term_hit(term: str, low: Column, words: Column) -> Column:
    """A text has a term if it holds it, or a token of four and more characters that the term begins with (document for documentation)."""
    starts = [term[:k] for k in range(4, len(term))]
    held = F.contains(low, F.lit(term))
    return held | F.arrays_overlap(words, F.array(*map(F.lit, starts))) if starts else held


def discriminative(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", cap: float = 0.1, penalty: float = 0.16, floor: float = 0.72) -> DataFrame:
    """id, coverage, boost, penalty: share of the weight of the query's rarer terms (idf at or above the median) that a document has; 1 without such terms."""
    terms = sorted(set(_tokens(query)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("low"), F.array_distinct(tx.tokens(text)).alias("words"))
    hits = [F.when(term_hit(t, F.col("low"), F.col("words")), F.lit(t)) for t in terms] or [F.lit(None).cast("string")]
    base = base.select("id", F.filter("words", lambda t: t.isin(terms)).alias("have"), F.array_compact(F.array(*hits)).alias("near"))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    df = base.select(F.explode("have").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = df.join(F.broadcast(n)).select("term", scoring.idf(F.col("n"), F.col("df")).alias("idf"))
    middle = weight.agg(F.median("idf").alias("mid"))
    salient = weight.join(F.broadcast(middle)).where("idf >= mid").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("w"), F.sum("idf").alias("all"))
    # one row with a query's terms
    got = base.join(F.broadcast(salient)).select("id", "all", F.aggregate("near", F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at("w", t), F.lit(0.0))).alias("got"))
    some = F.col("all") > 0
    share = F.when(some, F.col("got") / F.col("all")).otherwise(1.0)
    return got.select("id", share.alias("coverage"), some.alias("some")).select("id", "coverage", F.when(F.col("some"), cap * F.col("coverage")).otherwise(0.0).alias("boost"), F.greatest(F.lit(floor), 1 - penalty * (1 - F.col("coverage"))).alias("penalty"))


def vocabulary_overlap(names: DataFrame, query_words: list[str], id_col: str, name_col: str) -> DataFrame:
    """id, matched, score (matched words by query words) of names that share a word with the query."""
    words = F.array_intersect(tx.vocabulary(F.col(name_col)), F.array(*map(F.lit, query_words)))
    out = names.select(F.col(id_col).alias("id"), F.size(words).cast("long").alias("matched")).where("matched > 0")
    return out.withColumn("score", F.col("matched") / float(len(query_words)))


def per_group_top(df: DataFrame, group: str, score: str, k: int, tie: str = "id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
