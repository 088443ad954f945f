"""The modules' search plans: which files they take, blends, boosts, filters, match scales and limits, all as column expressions.

A module's plan is a projection and a filter over one table of features, so any number of modules is one pass: the
routing decides a row's module, and each formula is a case of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords, scoring
from . import paths

# Extensions of each module; the core takes all files.
MODULES = {
    "language/typescript": [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"],
    "language/python": [".py"],
    "language/go": [".go"],
    "language/rust": [".rs"],
    "docs/markdown": [".md", ".txt"],
    "data/json": [".json"],
}

# What a chunk's type adds, by module.
CHUNK_TYPES = {
    "language/typescript": {"function": 0.05, "class": 0.04, "interface": 0.04, "type": 0.03, "enum": 0.03, "variable": 0.02},
    "language/python": {"function": 0.05, "class": 0.04, "variable": 0.02},
    "language/go": {"function": 0.05, "class": 0.04, "interface": 0.04, "type": 0.02},
    "language/rust": {"function": 0.05, "class": 0.04, "interface": 0.04, "enum": 0.03, "type": 0.02},
}
EXPORTED = 0.03

# Query words that ask for documentation, and what they add to it.
DOC_WORDS = ["docs", "documentation", "readme", "guide", "how", "what", "explain"]
DOC_BOOST = 0.03


@dataclass(frozen=True)
class Weights:
    """Blends of the plans; fixed values."""

    typescript: tuple[float, float, float] = (0.43, 0.42, 0.15)  # cosine, BM25, vocabulary
    language: tuple[float, float] = (0.7, 0.3)
    markdown: tuple[float, float] = (0.62, 0.33)
    json: float = 0.4
    json_literal: float = 0.6  # part of the literal base score without a BM25 score
    core: tuple[float, float] = (0.6, 0.4)  # BM25, symbols


@dataclass(frozen=True)
class Module:
    """A registered module: its id, the name to show, and whether it is enabled."""

    id: str
    enabled: bool = True
    options: dict = field(default_factory=dict)


def registry(enabled: list[str] | None = None) -> list[Module]:
    """All modules, core first; with a list only those are enabled."""
    return [Module(m, enabled is None or m in enabled) for m in ("core", *MODULES)]


def usable(modules: list[Module], indexed: list[str]) -> list[str]:
    """Ids of enabled modules that have an index."""
    return [m.id for m in modules if m.enabled and m.id in indexed]


def display_name(module: Column) -> Column:
    language = F.regexp_extract(module, "^language/(.+)$", 1)
    return F.when(module == "core", "Core").when(module == "language/typescript", "TypeScript").when(language != "", F.concat(F.upper(F.substring(language, 1, 1)), F.substr(language, F.lit(2)))).otherwise(module)


def module_of(path: Column) -> Column:
    """The module that takes a file besides the core; null for none."""
    ext, out = keywords.extension(path), F.lit(None).cast("string")
    for module, extensions in MODULES.items():
        out = F.when(ext.isin(extensions), module).otherwise(out)
    return out


def routed(files: DataFrame) -> DataFrame:
    """files: path. A row for every module that takes a file: the core, and the one of its extension."""
    own = F.array_compact(F.array(F.lit("core"), module_of(F.col("path"))))
    return files.withColumn("module", F.explode(own))


def _by_module(module: Column, cases: dict[str, Column], other: Column) -> Column:
    out = other
    for key, value in cases.items():
        out = F.when(F.startswith(module, F.lit(key)) if key.endswith("/") else module == key, value).otherwise(out)
    return out


def chunk_type_boost(module: Column, kind: Column) -> Column:
    def of(table: dict[str, float]) -> Column:
        return reduce(lambda out, kv: F.when(kind == kv[0], kv[1]).otherwise(out), table.items(), F.lit(0.0))

    return _by_module(module, {m: of(t) for m, t in CHUNK_TYPES.items()}, F.lit(0.0))


def export_boost(exported: Column) -> Column:
    return F.when(F.coalesce(exported, F.lit(False)), EXPORTED).otherwise(0.0)


def doc_boost(terms: list[str]) -> Column:
    return F.lit(DOC_BOOST if set(terms) & set(DOC_WORDS) else 0.0)


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(r"\s+", query.lower()) if len(t) > 2]


#: What a table of features has; what a module doesn't use may be 0, multiplier and penalty 1.
FEATURES = "chunk_id path module kind exported level cos b nb vocab symbol multiplier phrase coverage boost penalty".split()


def scored(features: DataFrame, query: str, min_score: float = 0.15, weights: Weights = Weights()) -> DataFrame:
    """features: FEATURES. Adds score, semantic, structured, and keeps what passes its module's bar.

    cos: cosine; b: capped BM25 score between 0 and 1; nb: the core's, 0 without a hit; symbol: the core's symbol score;
    phrase, coverage: phrase boost and share of query words; boost, penalty: of rare terms.
    """
    terms, c = query_terms(query), F.col
    files = features.withColumns({"path_boost": F.least(F.lit(0.2), paths.boost(c("path"), terms)), "type_boost": keywords.file_type_boost(c("path"), terms), "kind_boost": chunk_type_boost(c("module"), c("kind")), "export_boost": export_boost(c("exported"))})
    added = c("path_boost") + c("type_boost") + c("kind_boost") + c("export_boost")
    doc, heading = doc_boost(terms), keywords.heading_boost(c("level"), c("coverage"))
    ts, lang, md = weights.typescript, weights.language, weights.markdown
    literal = c("multiplier") > 1.0
    blended = {"language/typescript": ts[0] * c("cos") + ts[1] * c("b") + ts[2] * c("vocab"), "language/": lang[0] * c("cos") + lang[1] * c("b")}
    lifted = {k: F.when(literal & (v <= 0), BASE * c("multiplier")).otherwise(v * c("multiplier")) for k, v in blended.items()}
    disc = lambda x: (x + c("boost")) * c("penalty")
    json = F.when(literal & (c("b") <= 0), BASE * c("multiplier") + BASE * weights.json_literal).otherwise(weights.json * c("b") * c("multiplier"))
    core = weights.core[0] * c("nb") + weights.core[1] * c("symbol")
    score = _by_module(c("module"), {
        "language/": disc(lifted["language/"] + added),
        "language/typescript": disc(lifted["language/typescript"] + added + c("phrase")),
        "docs/markdown": disc(md[0] * c("cos") + md[1] * c("b") + doc + heading + c("phrase")),
        "data/json": json, "core": core,
    }, F.lit(0.0))
    none = F.lit(0.0)
    semantic = _by_module(c("module"), {"language/": scoring.semantic_share(c("cos")), "docs/markdown": scoring.semantic_share(c("cos"))}, none)
    structured = _by_module(c("module"), {
        "language/": c("b") + F.least(F.lit(0.3), added) + F.least(F.lit(0.12), 0.2 * c("coverage")),
        "language/typescript": (ts[1] * c("b") + ts[2] * c("vocab")) / (ts[1] + ts[2] + 1e-9) + F.least(F.lit(0.35), added) + F.least(F.lit(0.15), 0.25 * c("coverage")),
        "docs/markdown": md[1] * c("b") + doc + heading + F.least(F.lit(0.2), 0.15 * c("coverage")),
        "data/json": F.when(c("b") > 0.02, c("b")).otherwise(F.least(F.lit(1.0), 0.35 + F.least(F.lit(0.65), (c("multiplier") - 1) * 0.35))),
        "core": core,
    }, c("score"))
    passes = c("score") >= min_score
    keep = _by_module(c("module"), {
        "language/": passes | (c("b") > 0.3) | literal,
        "language/typescript": passes | (c("b") > 0.3) | literal | (c("vocab") > 0.4) | (c("phrase") >= 0.2),
        "docs/markdown": passes | (c("b") > 0.3) | (c("phrase") >= 0.2),
        "data/json": passes | literal,
        "core": ((c("nb") > 0) | (c("symbol") > 0)) & (c("score") >= CORE_MIN),
    }, passes)
    # literals of the two languages and JSON that nothing else found stay; the core and the others have none
    return files.withColumn("score", score).where(keep).withColumns({"semantic": semantic, "structured": scoring.clamp(structured)})


#: Score of a literal match without another score, and the core's own bar.
BASE, CORE_MIN = 0.5, 0.1


def top_per_module(results: DataFrame, k: int) -> DataFrame:
    """The best k of each module, by score, then chunk."""
    best = Window.partitionBy("module").orderBy(F.desc("score"), "chunk_id")
    return results.withColumn("module_rank", F.row_number().over(best)).where(F.col("module_rank") <= k)


def symbol_scores(symbols: DataFrame, tokens: list[str]) -> DataFrame:
    """symbols: path, name, exported. path, symbol: how well the names fit the query's tokens, at most 1.

    A query's few tokens are an array in the plan, so this is one pass over the symbols and one sum a file.
    """
    name = F.lower("name")
    parts = F.split(F.lower(F.regexp_replace(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")), r"\\s+")
    kind = F.when(F.coalesce("exported", F.lit(False)), 0).otherwise(1)

    def fit(t: Column) -> Column:
        near = F.contains(name, t) | F.contains(t, name)
        pick = lambda out, own: F.when(kind == 0, out).otherwise(own)
        part = F.exists(F.filter(parts, lambda p: F.length(p) > 2), lambda p: p == t)
        return F.when(name == t, pick(1.0, 0.8)).when(near, pick(0.5, 0.4)).when(part, pick(0.3, 0.2)).otherwise(0.0)

    total = F.aggregate(F.transform(F.array(*map(F.lit, tokens)), fit), F.lit(0.0), lambda s, x: s + x) if tokens else F.lit(0.0)
    out = symbols.where(F.length("name") > 0).select("path", total.alias("s")).where("s > 0").groupBy("path").agg(F.sum("s").alias("s"))
    return out.select("path", F.least(F.lit(1.0), F.col("s") / len(tokens)).alias("symbol")) if tokens else out.select("path", F.col("s").alias("symbol"))


def chunk_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunks: path, ord, start_line, end_line; symbols: path, line, ord, name, type, exported. Adds name, kind, exported and n_symbols: the first symbol in
    the chunk's lines gives them; a chunk without one is a block."""
    s = symbols.select("path", "line", F.col("ord").alias("sym_ord"), "name", "type", "exported")
    kind = F.when(F.col("type").isin("function", "method"), "function").when(F.col("type").isin("class", "interface", "type", "enum", "variable"), F.col("type")).otherwise("block")
    inside = chunks.select("path", "ord", "start_line", "end_line").join(s, "path").where("line BETWEEN start_line AND end_line")
    first = inside.groupBy("path", "ord").agg(F.min_by(F.struct("name", kind.alias("kind"), "exported"), F.struct("line", "sym_ord")).alias("f"), F.count(F.lit(1)).alias("n_symbols"))
    out = chunks.join(first, ["path", "ord"], "left")
    return out.select(*chunks.columns, F.col("f.name").alias("name"), F.coalesce("f.kind", F.lit("block")).alias("kind"), F.coalesce("f.exported", F.lit(False)).alias("exported"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def best_chunks(chunks: DataFrame, tokens: list[str]) -> DataFrame:
    """chunks: path, ord, content, name, exported. The best chunk of each file: query tokens in its text, twice those in its name, and a half if it is exported."""
    text, name = F.lower("content"), F.lower(F.coalesce("name", F.lit("")))
    hits = sum((F.contains(text, F.lit(t)).cast("int") + 2 * F.contains(name, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    rows = chunks.withColumn("s", hits + F.when(F.coalesce("exported", F.lit(False)), 0.5).otherwise(0.0))
    first = Window.partitionBy("path").orderBy(F.desc("s"), "ord")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").withColumnRenamed("s", "chunk_score")


def summaries(chunks: DataFrame) -> DataFrame:
    """chunks: path, kind, name, exported, keywords. path, chunks, kinds, keywords, exports: what a file's chunks have, in order of the alphabet."""
    exports = F.collect_set(F.when(F.coalesce("exported", F.lit(False)), F.col("name")))
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords"))))
    return chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_set("kind")).alias("kinds"), words.alias("keywords"), F.array_sort(exports).alias("exports"))
