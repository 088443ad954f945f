"""Keywords of Markdown, of JSON and of a query's intent, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query words that ask for code, and such that ask for documentation (these win).
CODE_WORDS = "function method class interface implement implementation endpoint route handler controller module code".split()
DOC_WORDS = "documentation docs guide tutorial readme how what why explain overview getting started requirements setup install configure configuration".split()

# Extensions of source code and of documentation, and the boosts of each.
CODE_EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java".split()
DOC_EXTENSIONS = ".md .txt .rst".split()
CODE_BOOST, DOC_BOOST = 0.06, 0.08

# Boost of a heading by level, and the part of it that needs no phrase coverage.
HEADING_BOOST = {1: 0.01, 2: 0.02, 3: 0.03, 4: 0.05, 5: 0.05, 6: 0.05}
HEADING_BASE = 0.25


def intent(terms: list[str]) -> str:
    if set(terms) & set(DOC_WORDS):
        return "documentation"
    return "implementation" if set(terms) & set(CODE_WORDS) else "neutral"


def extension(path: Column) -> Column:
    """The last suffix of the file name in lower case, with its dot; empty when there is none or the name starts with it."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def file_type_boost(path: Column, terms: list[str]) -> Column:
    wanted, boost = {"documentation": (DOC_EXTENSIONS, DOC_BOOST), "implementation": (CODE_EXTENSIONS, CODE_BOOST)}.get(intent(terms), ([], 0.0))
    return F.when(extension(path).isin(wanted), boost).otherwise(0.0) if wanted else F.lit(0.0)


def heading_boost(level: Column, coverage: Column) -> Column:
    """By level, and by how much of the phrase the section covers."""
    raw = F.lit(0.0)
    for k, v in HEADING_BOOST.items():
        raw = F.when(level == k, v).otherwise(raw)
    return raw * (F.lit(HEADING_BASE) + F.lit(1 - HEADING_BASE) * coverage)


def _long_words(parts: Column, pattern: str) -> Column:
    words = F.flatten(F.transform(parts, lambda p: F.split(F.lower(p), pattern)))
    return F.filter(words, lambda w: F.length(w) > 2)


def markdown(text: Column) -> Column:
    """Words of headings, of emphasis and of links, and inline code; lower case, distinct, in this order."""
    every = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    strong = F.transform(every(r"\*\*.+?\*\*|\*.+?\*", 0), lambda s: F.regexp_replace(s, r"^\*{1,2}|\*{1,2}$", ""))
    code = F.filter(F.transform(every(r"`([^`]+)`", 1), F.lower), lambda c: (F.length(c) > 2) & (F.length(c) < 50))
    heads, links = every(r"(?m)^#{1,6}\s+(.+)$", 1), every(r"\[([^\]]+)\]", 1)
    return F.array_distinct(F.concat(_long_words(heads, r"\s+"), _long_words(strong, r"\s+"), code, _long_words(links, r"\s+")))


def json_words(text: Column) -> Column:
    """Keys (whole, and their words) and words of string values at every depth; invalid JSON has none.

    Strings are found by one pattern: after each, a colon tells a key.
    """
    valid = F.try_parse_json(text).isNotNull()
    strings = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    keys = F.transform(F.filter(strings, lambda s: F.endswith(s, F.lit(":"))), lambda s: F.regexp_replace(s, r'^"|"\s*:$', ""))
    values = F.transform(F.filter(strings, lambda s: ~F.endswith(s, F.lit(":"))), lambda s: F.regexp_replace(s, r'^"|"\s*$', ""))
    apart = lambda parts: F.transform(parts, lambda p: F.regexp_replace(p, "([a-z])([A-Z])", "$1 $2"))
    words = F.concat(F.transform(keys, F.lower), _long_words(apart(keys), r"[\s_-]+"), _long_words(apart(values), r"[\s_./-]+"))
    return F.when(valid, F.array_distinct(words)).otherwise(F.array().cast("array<string>"))
