"""Symbols of source code by line patterns, and code chunks by brackets or indentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What declares a symbol at the start of a line (kind, exported, pattern), in order of precedence.
SYMBOLS = [
    ("function", True, r"^export\s+(?:async\s+)?function\s+(\w+)"),
    ("function", True, r"^export\s+(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\("),
    ("class", True, r"^export\s+(?:abstract\s+)?class\s+(\w+)"),
    ("interface", True, r"^export\s+interface\s+(\w+)"),
    ("type", True, r"^export\s+type\s+(\w+)"),
    ("enum", True, r"^export\s+(?:const\s+)?enum\s+(\w+)"),
    ("variable", True, r"^export\s+(?:const|let|var)\s+(\w+)\s*(?::|=)"),
    ("function", True, r"^export\s+default\s+(?:async\s+)?function\s+(\w+)"),
    ("class", True, r"^export\s+default\s+class\s+(\w+)"),
    ("function", False, r"^(?:async\s+)?function\s+(\w+)"),
    ("function", False, r"^(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\("),
    ("class", False, r"^(?:abstract\s+)?class\s+(\w+)"),
    ("interface", False, r"^interface\s+(\w+)"),
    ("type", False, r"^type\s+(\w+)"),
    ("enum", False, r"^(?:const\s+)?enum\s+(\w+)"),
    ("function", False, r"^def\s+(\w+)\s*\("),
    ("class", False, r"^class\s+(\w+)(?:\s*\(|:)"),
    ("function", False, r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\("),
    ("type", False, r"^type\s+(\w+)\s+(?:struct|interface)"),
    ("function", False, r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
    ("type", False, r"^(?:pub\s+)?struct\s+(\w+)"),
    ("enum", False, r"^(?:pub\s+)?enum\s+(\w+)"),
    ("interface", False, r"^(?:pub\s+)?trait\s+(\w+)"),
]

_MAY = r"^(?:export|async|function|const|let|abstract|class|interface|type|enum|def|func|pub|fn|struct|trait)\s"


def symbols(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, kind, line, exported. Of declarations with equal name and kind the first pattern's first stays."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "s")).where(F.col("s").rlike(_MAY))
    hits = [
        F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(out).alias("exported"), F.regexp_extract("s", p, 1).alias("name"))
        for k, (kind, out, p) in enumerate(SYMBOLS)
    ]
    found = lines.select("id", (F.col("at") + 1).cast("long").alias("line"), F.explode(F.filter(F.array(*hits), lambda h: h["name"] != "")).alias("h"))
    first = found.groupBy("id", F.col("h.name").alias("name"), F.col("h.kind").alias("kind")).agg(F.min(F.struct("h.k", "line", "h.exported")).alias("f"))
    return first.select("id", "name", "kind", "f.line", "f.exported")


def symbol_keywords(name: Column) -> Column:
    """The name in lower case, and its words of three and more characters."""
    words = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), r"[\s_]+")
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.filter(words, lambda w: F.length(w) > 2)))


_HIDDEN = {
    "python": re.compile(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|#[^\n]*"),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)+'"),
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\\n]|\\.)'"),
    "typescript": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"),
}
_LEAD = r"(?P<out>export\s+)?(?:default\s+)?(?:declare\s+)?"
_STARTS = {
    "typescript": [
        ("function", re.compile(_LEAD + r"(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)")),
        ("function", re.compile(_LEAD + r"(?:const|let|var)\s+(?P<name>[\w$]+)[^=\n]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=\n{]*=>|[\w$]+\s*=>)")),
        ("class", re.compile(_LEAD + r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)")),
        ("interface", re.compile(_LEAD + r"interface\s+(?P<name>[\w$]+)")),
        ("type", re.compile(_LEAD + r"type\s+(?P<name>[\w$]+)\b[^=\n]*=")),
        ("enum", re.compile(_LEAD + r"(?:const\s+)?enum\s+(?P<name>[\w$]+)")),
        ("variable", re.compile(r"(?P<out>export\s+)(?:const|let|var)\s+(?P<name>[\w$]+)")),
    ],
    "go": [("function", re.compile(r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)")), ("class", re.compile(r"type\s+(?P<name>\w+)\s+struct\b")), ("interface", re.compile(r"type\s+(?P<name>\w+)\s+interface\b"))],
    "rust": [
        ("function", re.compile(r"(?P<out>pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)")),
        ("class", re.compile(r"(?P<out>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)")),
        ("interface", re.compile(r"(?P<out>pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)")),
        ("enum", re.compile(r"(?P<out>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)")),
    ],
    "python": [("function", re.compile(r"(?:async\s+)?def\s+(?P<name>\w+)")), ("class", re.compile(r"class\s+(?P<name>\w+)"))],
}
_DOC = {"typescript": re.compile(r"^\s*(?:/\*\*|\*|\*/)"), "go": re.compile(r"^//"), "rust": re.compile(r"^///"), "python": re.compile(r"^@")}
LANGUAGES = tuple(_STARTS)


def _bare(text: str, language: str) -> list[str]:
    """The lines with comments and strings blanked out."""
    return _HIDDEN[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text).split("\n")


def _end(lines: list[str], at: int, language: str) -> int:
    """Last line of the declaration that starts on line `at`."""
    if language == "python":
        last, depth = at, 0
        for i in range(at, len(lines)):
            if i > at and depth <= 0 and lines[i].strip() and not lines[i][0].isspace():
                break
            depth += sum(lines[i].count(c) for c in "([{") - sum(lines[i].count(c) for c in ")]}")
            last = i if lines[i].strip() else last
        return last
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c in "([{":
                depth, opened = depth + 1, opened or c == "{"
            elif c in ")]}":
                depth -= 1
            elif c == ";" and depth <= 0:
                return i
        if opened and depth <= 0:
            return i
        if not opened and depth <= 0 and i + 1 < len(lines) and not lines[i + 1].strip() and lines[i].strip() and not re.search(r"[=,|&(]\s*$", lines[i]):
            return i
    return len(lines) - 1


def parse(text: str, language: str) -> list[tuple[str, str | None, int, int, bool, str | None, str]]:
    """kind, name, first line, last line (from 1), exported, doc, content of the top-level declarations in order; without any, one `file` chunk."""
    lines = text.split("\n")
    out, at, bare = [], 0, _bare(text, language) if language in _STARTS else []
    while at < len(bare):
        line = bare[at]
        hit = None if not line or line[0].isspace() else next(((k, m) for k, p in _STARTS[language] if (m := p.match("\n".join(bare[at : at + 4])))), None)
        if hit is None:
            at += 1
            continue
        kind, m = hit
        end, name = _end(bare, at, language), m["name"]
        exported = name[:1].isupper() if language == "go" else not name.startswith("_") if language == "python" else bool(m["out"])
        first = at
        while first and _DOC[language].match(lines[first - 1]):
            first -= 1
        doc = "\n".join(lines[first:at]).strip() or None
        if language == "python":
            head = next((i for i in range(at, end) if bare[i].rstrip().endswith(":")), at)
            quoted = re.match(r"\s*(?:\"\"\"|''')([\s\S]*?)(?:\"\"\"|''')", "\n".join(lines[head + 1 : end + 1]))
            doc = quoted[1].strip() if quoted else None
        out.append((kind, name, at + 1, end + 1, exported, doc, "\n".join(lines[at : end + 1])))
        at = end + 1
    return out or [("file", None, 1, len(lines), False, None, text)]


def chunks(df: DataFrame, id_col: str, text_col: str, language_col: str, full: bool = True) -> DataFrame:
    """id, kind, name, start_line, end_line, exported, doc, content. full: the whole file comes as a chunk too when there are several.

    A null text has no chunk; other languages give one `file` chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, lang in zip(b["id"].tolist(), b["text"].tolist(), b["lang"].tolist()):
                own = parse(text, lang)
                if full and len(own) > 1:
                    rows.append((i, "file", None, 1, text.count("\n") + 1, False, None, text))
                rows += [(i, *c) for c in own]
            yield pd.DataFrame(rows, columns=["id", "kind", "name", "start_line", "end_line", "exported", "doc", "content"])

    ids = df.schema[id_col].dataType.simpleString()
    told = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(language_col, F.lit("")).alias("lang")).where("text IS NOT NULL")
    return told.mapInPandas(run, f"id {ids}, kind string, name string, start_line long, end_line long, exported boolean, doc string, content string")


def references(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (the file's path), target: relative imports and requires, resolved against the file's folder."""
    found = F.regexp_extract_all(text_col, F.lit(r"""(?:from\s+|require\(\s*|import\s+)['"](\.[^'"]*)['"]"""), F.lit(1))
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(found)).alias("to"))
    parts = F.split(F.concat(F.regexp_extract("id", r"^(.*/)?[^/]*$", 1), "to"), "/")
    empty = F.array().cast("array<string>")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    path = F.aggregate(parts, empty, lambda a, s: F.when(s.isin("", "."), a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
    return rows.select("id", F.array_join(path, "/").alias("target"))
