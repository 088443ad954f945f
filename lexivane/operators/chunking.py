"""Line chunkers, markdown sections and exact occurrences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """id, ord, start_line, end_line (from 1, inclusive), content: windows of size lines that share overlap lines."""
    step = size - overlap
    base = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    last = F.greatest(F.size("lines") - overlap - 1, F.lit(0))
    out = base.select("id", "lines", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("ord", "at"))
    end = F.least(F.col("at") + size, F.size("lines"))
    return out.select("id", "ord", (F.col("at") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", F.col("at") + 1, end - F.col("at")), "\n").alias("content"))


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.translate(path, "/\\.", "--_"), F.lit("-"), start, F.lit("-"), end)


def headings(docs: DataFrame, id_col: str, text_col: str, depth: int = 4) -> DataFrame:
    """id, line, level, title, end_line: sections of headings up to depth; a section ends before the next heading of its level or above."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(text_col, "\r", ""), "\n", -1)).alias("line", "s"))
    total = docs.select(F.col(id_col).alias("id"), F.size(F.split(text_col, "\n", -1)).alias("n"))
    heads = lines.where(F.col("s").rlike(r"^#{1,6}\s+\S")).select("id", (F.col("line") + 1).alias("line"), F.length(F.regexp_extract("s", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("s", r"^#+\s+", "")).alias("title"))
    # a heading ends at the nearest following one of any level up to its own: a running minimum a level
    after = Window.partitionBy("id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    ends = heads
    for k in range(1, depth + 1):
        ends = ends.withColumn(f"_e{k}", F.min(F.when(F.col("level") <= k, F.col("line"))).over(after))
    end = F.coalesce(*(F.when(F.col("level") == k, F.col(f"_e{k}")) for k in range(1, depth + 1)))
    return ends.where(F.col("level") <= depth).join(total, "id").select("id", "line", "level", "title", F.coalesce(end - 1, F.col("n")).alias("end_line"))


def occurrences(docs: DataFrame, literal: str, id_col: str, text_col: str, most: int = 5) -> DataFrame:
    """id, line (from 1), column (from 0), before, content, after: the first places of a literal in each document, overlapping ones too."""
    if not literal:
        return docs.select(F.col(id_col).alias("id")).where("false").selectExpr("id", "0 line", "0 column", "'' before", "'' content", "'' after")
    base = docs.where(F.contains(F.col(text_col), F.lit(literal))).select(F.col(id_col).alias("id"), F.split(text_col, "\n", -1).alias("lines"))
    rows = base.select("id", "lines", F.posexplode("lines").alias("k", "content")).where(F.contains("content", F.lit(literal)))
    places = F.filter(F.sequence(F.lit(0), F.length("content") - len(literal)), lambda i: F.substr(F.col("content"), i + 1, F.lit(len(literal))) == F.lit(literal))
    found = rows.select("id", "k", F.get("lines", F.col("k") - 1).alias("before"), "content", F.get("lines", F.col("k") + 1).alias("after"), F.explode(places).alias("column"))
    first = Window.partitionBy("id").orderBy("k", "column")
    return found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select("id", (F.col("k") + 1).alias("line"), "column", "before", "content", "after")


def match_counts(docs: DataFrame, literal: str, id_col: str, text_col: str) -> DataFrame:
    """id, matches: overlapping occurrences in the whole text."""
    pattern = f"(?=\\Q{literal}\\E)" if "\\E" not in literal else f"(?={re.escape(literal)})"
    found = docs.where(F.contains(F.col(text_col), F.lit(literal)))
    return found.select(F.col(id_col).alias("id"), F.regexp_count(text_col, F.lit(pattern)).cast("long").alias("matches"))


def generic_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 30, overlap: int = 5) -> DataFrame:
    """line_chunks() with a kind: a text of at most size lines is one chunk of kind file, others are blocks."""
    n = docs.select(F.col(id_col).alias("id"), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("n"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = n.where(F.col("n") <= size).select("id", F.lit(0).alias("ord"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"), F.col("text").alias("content"), F.lit("file").alias("kind"))
    return whole.unionByName(line_chunks(n.where(F.col("n") > size), "id", "text", size, overlap).withColumn("kind", F.lit("block")))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def markdown_chunks(docs: DataFrame, id_col: str, text_col: str, depth: int = 4) -> DataFrame:
    """id, kind (h1 to h4, preamble, full), level, title, start_line, end_line, content: sections with all that is nested in them,
    what stands before the first heading, or the whole text where there is none."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("lines", F.split("text", "\n", -1))
    marks = F.transform("lines", lambda s: F.length(F.regexp_extract(s, r"^(#{1,6})\s+.+$", 1)))
    base = base.withColumn("levels", marks).withColumn("heads", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("levels", i - 1) > 0))
    own = F.posexplode("heads").alias("k", "at")
    rows = base.where(F.size("heads") > 0).select("id", "lines", "levels", "heads", own).withColumn("level", F.get("levels", F.col("at") - 1)).where(F.col("level") <= depth)
    later = F.filter(F.slice("heads", F.col("k") + 2, F.size("heads")), lambda i: F.get("levels", i - 1) <= F.col("level"))
    rows = rows.withColumn("end_line", F.coalesce(F.get(later, F.lit(0)) - 1, F.size("lines")))
    body = F.array_join(F.slice("lines", F.col("at"), F.col("end_line") - F.col("at") + 1), "\n")
    sections = rows.select("id", F.concat(F.lit("h"), "level").alias("kind"), "level", F.regexp_extract(F.get("lines", F.col("at") - 1), r"^#{1,6}\s+(.+)$", 1).alias("title"), F.col("at").alias("start_line"), "end_line", body.alias("content"))
    first = F.get("heads", F.lit(0)) - 1
    before = base.where((F.size("heads") > 0) & (first > 0)).select("id", first.alias("end_line"), _trimmed(F.array_join(F.slice("lines", F.lit(1), first), "\n")).alias("content")).where("content != ''")
    plain = base.where(F.size("heads") == 0).select("id", F.size("lines").alias("end_line"), F.col("text").alias("content"))
    others = [df.select("id", F.lit(kind).alias("kind"), F.lit(0).alias("level"), F.lit("").alias("title"), F.lit(1).alias("start_line"), "end_line", "content") for df, kind in ((before, "preamble"), (plain, "full"))]
    return sections.unionByName(others[0]).unionByName(others[1])


def flat_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord, level, title, start_line, end_line, content: each heading with the text up to the next heading of any level; level 0 for what has none before it."""
    base = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    levels = F.transform("lines", lambda s: F.length(F.regexp_extract(s, r"^(#{1,6})\s+.+$", 1)))
    heads = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("levels", i - 1) > 0)
    base = base.withColumn("levels", levels).withColumn("heads", heads)
    starts = F.when(F.get("heads", F.lit(0)) == 1, F.col("heads")).otherwise(F.concat(F.array(F.lit(1)), "heads"))
    rows = base.withColumn("starts", starts).select("id", "lines", "levels", "starts", F.posexplode("starts").alias("ord", "start_line"))
    rows = rows.withColumn("end_line", F.coalesce(F.get("starts", F.col("ord") + 1) - 1, F.size("lines"))).withColumn("level", F.get("levels", F.col("start_line") - 1))
    skip = F.when(F.col("level") > 0, 1).otherwise(0)
    body = _trimmed(F.array_join(F.slice("lines", F.col("start_line") + skip, F.col("end_line") - F.col("start_line") + 1 - skip), "\n"))
    title = F.regexp_extract(F.get("lines", F.col("start_line") - 1), r"^#{1,6}\s+(.+)$", 1)
    return rows.select("id", "ord", "level", F.when(F.col("level") > 0, title).otherwise("").alias("title"), "start_line", "end_line", body.alias("content"))


def json_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind, start_line, end_line, content: a valid JSON text is one chunk; others are left out.

    Valid is what the JVM's parser takes, which doesn't look at what follows the value.
    """
    text = F.col(text_col)
    return docs.where(F.try_parse_json(text).isNotNull()).select(F.col(id_col).alias("id"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n", -1)).alias("end_line"), text.alias("content"))
