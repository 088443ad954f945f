"""Literal index: names, imports and type references of chunks as a table; matches by name and by vocabulary; their scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text as tx

# The literal's type by the chunk's; others are identifiers.
LITERAL_TYPES = {"class": "className", "function": "functionName", "interface": "interfaceName", "type": "typeName", "enum": "enumName", "variable": "variableName"}

# Words that a query's vocabulary leaves out.
QUERY_STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "to", "of", "in", "for", "on", "at", "by", "or", "as", "if",
    "what", "where", "when", "how", "why", "which", "who",
    "find", "show", "get", "list", "search",
    "and", "but", "with", "from", "that", "this", "these", "those", "it", "its",
    "code", "file", "function", "class", "method", "variable",
]

# Types that are no references.
BUILT_IN_TYPES = [
    "String", "Number", "Boolean", "Object", "Array", "Function", "Symbol", "BigInt", "Promise", "Map", "Set", "WeakMap", "WeakSet", "Date", "RegExp", "Error",
    "Partial", "Required", "Readonly", "Record", "Pick", "Omit", "Exclude", "Extract", "NonNullable", "ReturnType", "InstanceType", "Parameters", "ConstructorParameters", "Awaited",
]

#: The better kind of match comes first.
ORDER = ["definition", "reference", "import"]
#: The score of a match without another score.
BASE_SCORE = 0.5


def query_vocabulary(query: str) -> list[str]:
    """A query's words without stop words; words with underscores are taken apart. A query is one string."""
    out: dict[str, None] = {}
    for word in re.findall(r"\w{2,}", query.lower(), re.ASCII):
        if word not in QUERY_STOP_WORDS:
            parts = word.split("_") if "_" in word else [word]
            out |= dict.fromkeys(p for p in parts if len(p) > 1 and p not in QUERY_STOP_WORDS)
    return list(out)


def _lookup(key: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def definitions(chunks: DataFrame) -> DataFrame:
    """chunks: chunk_id, path, name, type. Returns chunk_id, path, value, literal_type, match_type: each named chunk's own name."""
    named = chunks.where(F.coalesce(F.length("name"), F.lit(0)) > 0)
    return named.select("chunk_id", "path", F.col("name").alias("value"), _lookup(F.col("type"), LITERAL_TYPES, "identifier").alias("literal_type"), F.lit("definition").alias("match_type"))


def references(chunks: DataFrame) -> DataFrame:
    """chunks: chunk_id, path, name, content. Imported names in Pascal case, and types that are extended or implemented."""
    every = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    listed = F.flatten(F.transform(every(r"import\s*\{([^}]+)\}\s*from"), lambda s: F.split(s, ",")))
    named = F.transform(listed, lambda s: F.trim(F.regexp_replace(s, r"(?s)\s+as\s.*$", "")))
    pascal = F.filter(named, lambda s: s.rlike("^[A-Z][a-zA-Z0-9]*$"))
    imports = F.concat(pascal, every(r"import\s+([A-Z][a-zA-Z0-9]*)\s+from"))
    types = F.filter(every(r"(?:extends|implements)\s+([A-Z][a-zA-Z0-9]*)"), lambda s: ~s.isin(BUILT_IN_TYPES))
    own = F.lower(F.coalesce("name", F.lit("")))
    found = [chunks.select("chunk_id", "path", own.alias("own"), F.posexplode(v).alias("at", "value"), F.lit(kind).alias("match_type")) for v, kind in ((imports, "import"), (types, "reference"))]
    rows = found[0].unionByName(found[1]).where(F.lower("value") != F.col("own"))
    first = Window.partitionBy("chunk_id", F.lower("value")).orderBy(F.col("match_type"), "at")  # imports come before references
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("chunk_id", "path", "value", F.lit("className").alias("literal_type"), "match_type")


def literal_index(chunks: DataFrame, deep: bool = False) -> DataFrame:
    """chunk_id, path, key, value, literal_type, match_type, vocabulary: one row a chunk and key, the best kind of match."""
    rows = definitions(chunks)
    rows = rows.unionByName(references(chunks)) if deep else rows
    rows = rows.withColumn("key", F.lower("value"))
    best = Window.partitionBy("chunk_id", "key").orderBy(_rank(F.col("match_type")), "value")
    rows = rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return rows.select("chunk_id", "path", "key", "value", "literal_type", "match_type", tx.vocabulary(F.col("value")).alias("vocabulary"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), kind)


def matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: value, confidence of a query's few literals. Rows of the index with the same name in any case, and whether the case is the same."""
    q = F.broadcast(wanted.select(F.lower("value").alias("key"), F.col("value").alias("asked"), "confidence"))
    return index.join(q, "key").withColumn("exact", F.col("value") == F.col("asked"))


def contributions(found: DataFrame) -> DataFrame:
    """chunk_id, multiplier, match_type, confidence (of the best match, the first of equals), matches."""
    weight = F.lit(None).cast("double")
    for (kind, sure), w in scoring.LITERAL.items():
        weight = F.when((F.col("match_type") == kind) & (F.col("confidence") == sure), w).otherwise(weight)
    rows = found.withColumn("w", weight)
    best = F.max_by(F.struct("match_type", "confidence"), F.struct("w", -_rank(F.col("match_type")), "asked"))
    out = rows.groupBy("chunk_id").agg(F.max("w").alias("multiplier"), best.alias("b"), F.count(F.lit(1)).alias("matches"))
    return out.select("chunk_id", "multiplier", "b.match_type", "b.confidence", "matches")


def vocabulary_matches(index: DataFrame, words: list[str]) -> DataFrame:
    """chunk_id, value, matched: distinct query words by chunk and name."""
    hits = index.select("chunk_id", "value", F.explode("vocabulary").alias("word")).where(F.col("word").isin(words))
    return hits.groupBy("chunk_id", "value").agg(F.count_distinct("word").alias("matched"))


def vocabulary_scores(index: DataFrame, words: list[str]) -> DataFrame:
    """chunk_id, vocab: the best name's share of the query's words."""
    found = vocabulary_matches(index, words)
    return found.groupBy("chunk_id").agg((F.max("matched") / F.lit(float(max(1, len(words))))).alias("vocab"))


def merged(scored: DataFrame, contributed: DataFrame) -> DataFrame:
    """scored: chunk_id, base. All chunks of either side: base times the multiplier, or BASE_SCORE times it without a base; literal_only."""
    both = scored.join(contributed, "chunk_id", "full")
    score = F.when(F.col("base").isNull(), BASE_SCORE * F.col("multiplier")).otherwise(F.col("base") * F.coalesce("multiplier", F.lit(1.0)))
    return both.select("chunk_id", F.coalesce("base", F.lit(0.0)).alias("base"), score.alias("score"), F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"), F.col("base").isNull().alias("literal_only"), F.coalesce("matches", F.lit(0)).alias("matches"))


def totals(index: DataFrame) -> DataFrame:
    """names, entries, words of an index: one row."""
    rows = index.select("key", "chunk_id", F.explode_outer("vocabulary").alias("word"))
    return rows.agg(F.count_distinct("key").alias("names"), F.count_distinct("chunk_id", "key").alias("entries"), F.count_distinct("word").alias("words"))


def without_chunks(index: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: chunk_id."""
    return index.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")
