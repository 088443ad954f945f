"""Tokenisers and identifier functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that queries leave out when words are matched.
STOP_WORDS = [
    "a", "an", "the",
    "in", "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "and", "or", "but",
    "what", "where", "when", "how", "why", "which", "who",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "i", "you", "he", "she", "it", "we", "they", "this", "that", "these", "those",
]

# Words too common in code to be keywords.
COMMON_KEYWORDS = (
    "const let var function class interface type enum export import from return async await new this"
    " true false null undefined if else for while switch case break continue try catch finally"
    " throw typeof instanceof void delete in of string number boolean any unknown never object"
    " public private protected static readonly abstract implements extends super get set constructor"
    " the and for not with are was has have"
).split()


def tokens(text: Column) -> Column:
    """Lower-case runs of two and more ASCII word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w{2,}"), F.lit(0))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.isin(STOP_WORDS))


def query_terms(text: Column) -> Column:
    """Lower-case words of three and more characters, split at white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > 2)


def vocabulary(name: Column) -> Column:
    """Words of an identifier: split at - _ and case changes, lower case, two and more characters, distinct."""
    parts = F.split(name, r"[-_\s]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda t: F.length(t) > 1))


def keywords(text: Column, most: int = 50) -> Column:
    """First distinct identifiers of three and more characters that aren't common in code."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_]\w{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda t: ~t.isin(COMMON_KEYWORDS))), 1, most)


def is_identifier(query: Column) -> Column:
    """A quoted query, or one in SCREAMING, camel, Pascal, snake or kebab case."""
    q = F.trim(query)
    quoted = q.rlike("^([\"'`]).+[\"'`]$")
    cased = q.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$|^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$|^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)+$|^[a-z][a-z0-9]*(_[a-z0-9]+)+$|^[a-z][a-z0-9]*(-[a-z0-9]+)+$")
    return quoted | cased


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob: ** spans folders, * and ? don't, {a,b} are choices; without a slash any folder fits."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, c if c in "[]" else c if c.isalnum() or c in "_/-" else f"\\{c}")
        i += 1
    return f"^(?:.*/)?{out}$"
