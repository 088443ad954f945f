"""Score formulas as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# BM25, blends and multipliers.
K1, B = 1.5, 0.75
LITERAL = {("definition", "high"): 2.5, ("definition", "medium"): 2.0, ("definition", "low"): 1.5, ("reference", "high"): 2.0, ("reference", "medium"): 1.5, ("reference", "low"): 1.3, ("import", "high"): 1.5, ("import", "medium"): 1.3, ("import", "low"): 1.1}
CHUNK_TYPE = {"function": 0.05, "class": 0.04, "interface": 0.04, "type": 0.03, "enum": 0.03, "variable": 0.02}
HEADING = {1: 0.01, 2: 0.02, 3: 0.03, 4: 0.05, 5: 0.05, 6: 0.05}


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def bm25_term(weight: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def sigmoid(score: Column, mid: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-score / mid + 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different lengths raise."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).when(size > 0, dot(a, b) / size).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(F.sqrt(gap))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))


def semantic_share(cos: Column) -> Column:
    return clamp((cos + 1) / 2)


def coverage(text: Column, words: Sequence[str]) -> Column:
    """Share of words that the text contains as substrings."""
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) / F.lit(float(max(1, len(words))))


def phrase_boost(text: Column, phrase: str, words: Sequence[str]) -> Column:
    share = coverage(text, words)
    return F.when(F.contains(F.lower(text), F.lit(phrase)), 0.5).when(share >= 0.8, 0.2).when(share >= 0.6, 0.1).otherwise(0.0)


def literal_boost(base: Column, multiplier: Column) -> Column:
    """No match: the base; a match without a base: half the multiplier; else their product."""
    return F.when(multiplier <= 1.0, base).when(base <= 0, 0.5 * multiplier).otherwise(base * multiplier)


def lookup(key: Column, table: dict) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out
