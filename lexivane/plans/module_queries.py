"""Literals, module plans, places of files, sections, stored search; their SQL has its own lists, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_paths as jp, lexicon, scoring, text as tx
from ..operators import chunking, embedding, incremental, lexical, literals, modules, paths, search, structure  # noqa: F401
from .code_queries import _FILES, _files
from .lexical_queries import BM25, TOKENS, WORDS
from .registry import query
from .retrieval_queries import _HYBRID

# -- documents as chunks of seven kinds of files -----------------------------------------------------

_KIND = "['function', 'class', 'interface', 'type', 'enum', 'variable', 'file'][(doc_id // 7 % 7 + 1)::INT]"
_EXT = "['.ts', '.py', '.go', '.rs', '.md', '.json', '.xyz'][(doc_id % 7 + 1)::INT]"
_MODULE = "['language/typescript', 'language/python', 'language/go', 'language/rust', 'docs/markdown', 'data/json', 'core'][(doc_id % 7 + 1)::INT]"
_CHUNKS = f"SELECT doc_id, text, lang, source, lang || '/' || source || '/file_' || doc_id || {_EXT} AS path, {_MODULE} AS module, {_KIND} AS kind, doc_id % 2 = 0 AS exported, (doc_id % 8)::INT AS level, lang || 'Src' || (doc_id % 5) AS name FROM documents"


def _pick(words, by):
    return F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))


def _chunks(t):
    d = F.col("doc_id")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/file_"), "doc_id", _pick([".ts", ".py", ".go", ".rs", ".md", ".json", ".xyz"], d))
    rows = t.documents.select("doc_id", "text", "lang", "source", path.alias("path"))
    return rows.withColumns({
        "module": F.coalesce(modules.module_of(F.col("path")), F.lit("core")), "exported": d % 2 == 0, "level": (d % 8).cast("int"),
        "kind": _pick(["function", "class", "interface", "type", "enum", "variable", "file"], F.floor(d / 7)), "name": F.concat("lang", F.lit("Src"), d % 5),
    })


#: A query's literals with their confidence, words of its vocabulary, tokens for symbols, and the query for paths and intents.
_WANTED = [("enSrc3", "medium"), ("FRsrc1", "high"), ("desrc0", "low")]
_VOCAB = ["src3", "fr", "node"]
_SYMBOLS = ["src3", "en", "desrc0"]
_ASKED = "src1 guide fr function"


def _literal_index(t):
    return literals.literal_index(_chunks(t).select(F.col("doc_id").alias("chunk_id"), "path", "name", F.col("kind").alias("type")))


def _wanted(t):
    return t.spark.createDataFrame(_WANTED, "value string, confidence string")


_LIT = f"SELECT doc_id AS chunk_id, name AS value, lower(name) AS key, kind, path FROM ({_CHUNKS})"
_Q = "(VALUES ('enSrc3', 'medium', 2.0::DOUBLE), ('FRsrc1', 'high', 2.5::DOUBLE), ('desrc0', 'low', 1.5::DOUBLE)) q(asked, confidence, w)"


@query(f"SELECT chunk_id, value, CASE kind WHEN 'function' THEN 'functionName' WHEN 'class' THEN 'className' WHEN 'interface' THEN 'interfaceName' WHEN 'type' THEN 'typeName' WHEN 'enum' THEN 'enumName' WHEN 'variable' THEN 'variableName' ELSE 'identifier' END AS literal_type, 'definition' AS match_type FROM ({_LIT})")
def literal_definitions(t):
    return _literal_index(t).select("chunk_id", "value", "literal_type", "match_type")


@query(f"SELECT chunk_id, asked, value = asked AS exact FROM ({_LIT}) JOIN {_Q} ON key = lower(asked)")
def literal_matches(t):
    return literals.matches(_literal_index(t), _wanted(t)).select("chunk_id", "asked", "exact")


@query(f"SELECT chunk_id, max(w) AS multiplier, 'definition' AS match_type, arg_max(confidence, w) AS confidence, count(*)::BIGINT AS matches FROM ({_LIT}) JOIN {_Q} ON key = lower(asked) GROUP BY chunk_id")
def literal_contributions(t):
    return literals.contributions(literals.matches(_literal_index(t), _wanted(t)))


@query(f"SELECT chunk_id, value, (lower(value[1:2]) = 'fr')::BIGINT + (lower(value[3:]) = 'src3')::BIGINT AS matched FROM ({_LIT}) WHERE value[1:2] = 'fr' OR lower(value[3:]) = 'src3'")
def vocabulary_matches(t):
    return literals.vocabulary_matches(_literal_index(t), _VOCAB)


@query(f"SELECT coalesce(s.chunk_id, c.chunk_id) AS chunk_id, coalesce(base, 0) AS base, CASE WHEN base IS NULL THEN 0.5::DOUBLE * w ELSE base * coalesce(w, 1) END AS score, coalesce(w, 1) AS multiplier, base IS NULL AS literal_only, coalesce(n, 0)::BIGINT AS matches FROM (SELECT doc_id AS chunk_id, toxic + 0.25::DOUBLE AS base FROM labels) s FULL JOIN (SELECT chunk_id, max(w) AS w, count(*) AS n FROM ({_LIT}) JOIN {_Q} ON key = lower(asked) GROUP BY chunk_id) c ON s.chunk_id = c.chunk_id")
def literal_merge(t):
    scored = t.labels.select(F.col("doc_id").alias("chunk_id"), (F.col("toxic") + F.lit(0.25)).alias("base"))
    return literals.merged(scored, literals.contributions(literals.matches(_literal_index(t), _wanted(t))))


@query(f"SELECT count(DISTINCT key)::BIGINT AS names, count(*)::BIGINT AS entries, (count(DISTINCT lang) + count(DISTINCT lower(value[3:])))::BIGINT AS words FROM (SELECT *, value[1:2] AS lang FROM ({_LIT})) WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def literal_totals(t):
    gone = t.labels.where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return literals.totals(literals.without_chunks(_literal_index(t), gone))


#: A part as a class that extends another's name, with imports: `cold widget` gives ColdWidget.
_PASCAL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"
_CODE = "'import { ' || p || ' as Own, other, Tool } from ''x''' || chr(10) || 'import Base from ''y''' || chr(10) || 'class A extends Base implements Map { }' || chr(10) || 'class B extends ' || p || 'Kind {}'"


def _code(t):
    pascal = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    text = F.concat(F.lit("import { "), "p", F.lit(" as Own, other, Tool } from 'x'\nimport Base from 'y'\nclass A extends Base implements Map { }\nclass B extends "), "p", F.lit("Kind {}"))
    return t.part.select(F.col("p_partkey").alias("chunk_id"), F.lit("a.ts").alias("path"), pascal.alias("p")).withColumn("content", text).withColumn("name", F.when(F.col("chunk_id") % 2 == 0, F.col("p")))


@query(f"WITH c AS (SELECT p_partkey AS chunk_id, {_PASCAL} AS p FROM part) SELECT chunk_id, unnest(list_filter([[p, 'import'], ['Tool', 'import'], ['Base', 'import'], [p || 'Kind', 'reference']], lambda x: NOT (chunk_id % 2 = 0 AND x[1] = p)))[1] AS value, unnest(list_filter([[p, 'import'], ['Tool', 'import'], ['Base', 'import'], [p || 'Kind', 'reference']], lambda x: NOT (chunk_id % 2 = 0 AND x[1] = p)))[2] AS match_type FROM c")
def literal_references(t):
    return literals.references(_code(t)).select("chunk_id", "value", "match_type")


@query("SELECT unnest(['user', 'session', 'validated', 'max', 'retry', 'count']) AS word")
def query_vocabulary(t):
    words = literals.query_vocabulary("where is the user session validated, find MAX_RETRY_COUNT")
    return t.spark.createDataFrame([(w,) for w in words], "word string")


@query("SELECT unnest(['refactor', 'auth', 'flow,', 'method', 'authentication', 'authorization', 'login', 'func']) AS term, unnest([1.0, 1.0, 1.0, 1.0, 0.9, 0.9, 0.6, 0.9])::DOUBLE AS weight")
def query_expansion(t):
    told = lexicon.expand("How should we refactor the auth flow, and which method", {**lexicon.BASIC, "auth": lexicon.BASIC["auth"][:3] + lexicon.BASIC["auth"][4:], "method": [("func", "strong")]}, most=8)
    return t.spark.createDataFrame([(a, b) for a, b, _, _ in told.terms], "term string, weight double")


# -- module plans ------------------------------------------------------------------------------------

_NEAR = "(contains({0}, 'src1') OR contains('src1', {0}) OR contains({0}, 'guide') OR contains('guide', {0}) OR contains({0}, 'function') OR contains('function', {0}))"
_FEATURES = f"""{_HYBRID},
nb AS (SELECT * FROM (WITH {BM25.replace(TOKENS, 'SELECT DISTINCT * FROM (' + TOKENS + ')')} SELECT id, 1 / (1 + exp(-bm25 / 5 + 1)) AS nb, row_number() OVER (ORDER BY bm25 DESC, id) AS r FROM b) WHERE r <= 40),
lit AS (SELECT chunk_id, max(w) AS mult FROM ({_LIT}) JOIN {_Q} ON key = lower(asked) GROUP BY chunk_id),
ch AS ({_CHUNKS}),
ft AS (SELECT ch.*, y.cos, y.b, y.share, y.coverage, y.ph, coalesce(nb.nb, 0) AS nb, coalesce(mult, 1) AS mult,
  ((lang = 'fr')::INT + (doc_id % 5 = 3)::INT) / 3.0::DOUBLE AS vocab,
  least(1, (CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END * CASE WHEN exported THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN contains(lower(name), 'en') THEN 1 ELSE 0 END * CASE WHEN exported THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END
    + CASE WHEN lower(name) = 'desrc0' THEN CASE WHEN exported THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END ELSE 0 END) / 3) AS symbol,
  CASE WHEN {_NEAR.format('source')} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {_NEAR.format('source')} OR {_NEAR.format('lang')} THEN 0.05::DOUBLE ELSE 0 END AS path_boost,
  CASE WHEN module = 'docs/markdown' THEN 0.08::DOUBLE ELSE 0 END AS type_boost, CASE WHEN exported THEN 0.03::DOUBLE ELSE 0 END AS export_boost,
  CASE level WHEN 1 THEN 0.01::DOUBLE WHEN 2 THEN 0.02::DOUBLE WHEN 3 THEN 0.03::DOUBLE WHEN 4 THEN 0.05::DOUBLE WHEN 5 THEN 0.05::DOUBLE WHEN 6 THEN 0.05::DOUBLE ELSE 0 END * (0.25::DOUBLE + 0.75::DOUBLE * y.coverage) AS heading
  FROM ch JOIN y ON y.id = ch.doc_id LEFT JOIN nb ON nb.id = ch.doc_id LEFT JOIN lit ON lit.chunk_id = ch.doc_id)"""


def _features(t):
    """Features of every chunk, each from its own operator."""
    chunks = _chunks(t)
    docs = t.documents.select("doc_id", "text")
    b = lexical.capped(lexical.bm25(docs, WORDS), 10)
    core = lexical.bm25(docs, WORDS, distinct=True).orderBy(F.desc("bm25"), "id").limit(40).select("id", scoring.sigmoid(F.col("bm25"), 5.0).alias("nb"))
    probe = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("probe")))  # one row
    vec = t.embeddings.join(probe).select(F.col("vec_id").alias("id"), scoring.cosine(F.col("embedding"), F.col("probe")).alias("cos"))
    index = _literal_index(t)
    lit = literals.contributions(literals.matches(index, _wanted(t))).select(F.col("chunk_id").alias("id"), "multiplier")
    vocab = literals.vocabulary_scores(index, _VOCAB).withColumnRenamed("chunk_id", "id")
    symbol = modules.symbol_scores(chunks.select("path", "name", "exported"), _SYMBOLS)
    words = sorted(set(WORDS.split()))
    rows = chunks.withColumn("id", F.col("doc_id")).withColumns({"phrase": scoring.phrase_boost(F.col("text"), WORDS, words), "coverage": scoring.coverage(F.col("text"), words)}).drop("text")
    for side in (b, core, vec, lit, vocab, lexical.discriminative(docs, WORDS).drop("coverage")):
        rows = rows.join(side, "id", "left")
    rows = rows.join(symbol, "path", "left").withColumn("chunk_id", F.col("doc_id"))
    return rows.fillna({"b": 0.0, "nb": 0.0, "cos": 0.0, "vocab": 0.0, "symbol": 0.0, "multiplier": 1.0})


def _module_sql(module: str, score: str, semantic: str, structured: str, keep: str) -> str:
    return f"""{_FEATURES}, k1 AS (SELECT *, {score} AS score FROM ft WHERE module = '{module}')
    SELECT doc_id AS chunk_id, round(score, 6) AS score, round({semantic}, 6) AS semantic, round(least(1, greatest(0, {structured})), 6) AS structured FROM k1 WHERE {keep}"""


def _plan(t, module):
    rows = modules.scored(_features(t).where(F.col("module") == module), _ASKED)
    return rows.select("chunk_id", *(F.round(c, 6).alias(c) for c in ("score", "semantic", "structured")))


def _typed(types: dict[str, float]) -> str:
    return "(CASE kind " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in types.items()) + " ELSE 0 END)"


_COS, _DISC = "least(1, greatest(0, (cos + 1) / 2))", "+ 0.1::DOUBLE * share) * greatest(0.72::DOUBLE, 1 - 0.16::DOUBLE * (1 - share))"
_TS_ADD = f"(path_boost + type_boost + export_boost + {_typed({'function': 0.05, 'class': 0.04, 'interface': 0.04, 'type': 0.03, 'enum': 0.03, 'variable': 0.02})})"
_TS_BASE = "(0.43::DOUBLE * cos + 0.42::DOUBLE * b + 0.15::DOUBLE * vocab)"


@query(_module_sql("language/typescript", f"(CASE WHEN mult > 1 AND {_TS_BASE} <= 0 THEN 0.5::DOUBLE * mult ELSE {_TS_BASE} * mult END + {_TS_ADD} + ph {_DISC}", _COS, f"(0.42::DOUBLE * b + 0.15::DOUBLE * vocab) / (0.57::DOUBLE + 1e-9) + least(0.35::DOUBLE, {_TS_ADD}) + least(0.15::DOUBLE, 0.25::DOUBLE * coverage)", "score >= 0.15 OR b > 0.3 OR mult > 1 OR vocab > 0.4 OR ph >= 0.2"))
def module_typescript(t):
    return _plan(t, "language/typescript")


def _language_sql(module: str, types: dict[str, float]) -> str:
    base, add = "(0.7::DOUBLE * cos + 0.3::DOUBLE * b)", f"(path_boost + type_boost + export_boost + {_typed(types)})"
    return _module_sql(module, f"(CASE WHEN mult > 1 AND {base} <= 0 THEN 0.5::DOUBLE * mult ELSE {base} * mult END + {add} {_DISC}", _COS, f"b + least(0.3::DOUBLE, {add}) + least(0.12::DOUBLE, 0.2::DOUBLE * coverage)", "score >= 0.15 OR b > 0.3 OR mult > 1")


@query(_language_sql("language/python", {"function": 0.05, "class": 0.04, "variable": 0.02}))
def module_python(t):
    return _plan(t, "language/python")


@query(_language_sql("language/go", {"function": 0.05, "class": 0.04, "interface": 0.04, "type": 0.02}))
def module_go(t):
    return _plan(t, "language/go")


@query(_language_sql("language/rust", {"function": 0.05, "class": 0.04, "interface": 0.04, "enum": 0.03, "type": 0.02}))
def module_rust(t):
    return _plan(t, "language/rust")


@query(_module_sql("docs/markdown", f"(0.62::DOUBLE * cos + 0.33::DOUBLE * b + 0.03::DOUBLE + heading + ph {_DISC}", _COS, "0.33::DOUBLE * b + 0.03::DOUBLE + heading + least(0.2::DOUBLE, 0.15::DOUBLE * coverage)", "score >= 0.15 OR b > 0.3 OR ph >= 0.2"))
def module_markdown(t):
    return _plan(t, "docs/markdown")


@query(_module_sql("data/json", "CASE WHEN mult > 1 AND b <= 0 THEN 0.5::DOUBLE * mult + 0.3::DOUBLE ELSE 0.4::DOUBLE * b * mult END", "0.0::DOUBLE", "CASE WHEN b > 0.02 THEN b ELSE least(1, 0.35::DOUBLE + least(0.65::DOUBLE, (mult - 1) * 0.35::DOUBLE)) END", "score >= 0.15 OR mult > 1"))
def module_json(t):
    return _plan(t, "data/json")


@query(_module_sql("core", "0.6::DOUBLE * nb + 0.4::DOUBLE * symbol", "0.0::DOUBLE", "0.6::DOUBLE * nb + 0.4::DOUBLE * symbol", "(nb > 0 OR symbol > 0) AND score >= 0.1"))
def module_core(t):
    return _plan(t, "core")


@query(f"SELECT path, unnest(list_filter(['core', CASE WHEN module = 'core' THEN NULL ELSE module END], lambda x: x IS NOT NULL)) AS module, CASE WHEN module = 'x' THEN '' ELSE '' END AS none FROM ({_CHUNKS})")
def module_routing(t):
    return modules.routed(_chunks(t).select("path")).withColumn("none", F.lit(""))


@query(f"SELECT DISTINCT module, CASE module WHEN 'core' THEN 'Core' WHEN 'language/typescript' THEN 'TypeScript' WHEN 'language/python' THEN 'Python' WHEN 'language/go' THEN 'Go' WHEN 'language/rust' THEN 'Rust' ELSE module END AS shown FROM ({_CHUNKS})")
def module_names(t):
    return _chunks(t).select("module").distinct().withColumn("shown", modules.display_name(F.col("module")))


@query(f"SELECT path, least(1, (CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END * CASE WHEN exported THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN contains(lower(name), 'en') THEN CASE WHEN exported THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END ELSE 0 END + CASE WHEN lower(name) = 'desrc0' THEN CASE WHEN exported THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END ELSE 0 END) / 3) AS symbol FROM ({_CHUNKS}) WHERE doc_id % 5 = 3 OR lang = 'en' OR lower(name) = 'desrc0'")
def core_symbol_scores(t):
    return modules.symbol_scores(_chunks(t).select("path", "name", "exported"), _SYMBOLS)


def _symbols(t):
    """A symbol on every 20th line of a document, named by its first word."""
    lines = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("k", "s")).where("k % 20 = 3")
    return lines.select("path", (F.col("k") + 1).alias("line"), F.lit(0).alias("ord"), F.concat(F.lit("s"), F.col("k")).alias("name"), F.when(F.col("k") % 40 == 3, "method").otherwise("class").alias("type"), (F.col("k") % 3 == 0).alias("exported"))


def _line_chunks(t):
    return chunking.line_chunks(t.documents, "doc_id", "text", 50, 10).withColumn("path", F.col("id").cast("string"))


_LINES = "SELECT doc_id, unnest(range(0, greatest(len(string_split(text, chr(10))) - 11, 0) + 1, 40)) + 1 AS start_line, len(string_split(text, chr(10))) AS n FROM documents"
_IN_CHUNK = f"SELECT doc_id::VARCHAR AS path, start_line, list_filter(range(3, n, 20), lambda k: k + 1 BETWEEN start_line AND least(start_line + 49, n)) AS ks FROM ({_LINES})"


@query(f"SELECT path, start_line::INT AS start_line, 's' || ks[1] AS name, CASE WHEN ks[1] IS NULL THEN 'block' WHEN ks[1] % 40 = 3 THEN 'function' ELSE 'class' END AS kind, coalesce(ks[1] % 3 = 0, false) AS exported, len(ks)::BIGINT AS n_symbols FROM ({_IN_CHUNK})")
def chunk_symbols(t):
    return modules.chunk_symbols(_line_chunks(t), _symbols(t)).select("path", "start_line", "name", "kind", "exported", "n_symbols")


@query(f"WITH l AS (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS x FROM documents), c AS (SELECT path, start_line, 's' || ks[1] AS name, coalesce(ks[1] % 3 = 0, false) AS exported, lower(array_to_string(x[start_line:least(start_line + 49, len(x))], chr(10))) AS t FROM ({_IN_CHUNK}) JOIN l USING (path)), s AS (SELECT *, contains(t, 'thand')::INT + contains(t, 'junk|')::INT + contains(t, 's3')::INT + 2 * coalesce(contains(name, 's3'), false)::INT + CASE WHEN exported THEN 0.5::DOUBLE ELSE 0 END AS chunk_score FROM c) SELECT path, start_line::INT AS start_line, chunk_score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY chunk_score DESC, start_line) AS r FROM s) WHERE r = 1")
def best_chunks(t):
    chunks = modules.chunk_symbols(_line_chunks(t), _symbols(t))
    return modules.best_chunks(chunks, ["thand", "junk|", "s3"]).select("path", "start_line", "chunk_score")


@query(f"SELECT lang AS path, count(*)::BIGINT AS chunks, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, array_to_string(list_sort(list_distinct(flatten(list([source, name])))), ',') AS keywords, array_to_string(coalesce(list_sort(list(DISTINCT name) FILTER (exported)), []), ',') AS exports FROM ({_CHUNKS}) GROUP BY lang")
def file_summaries(t):
    rows = _chunks(t).select(F.col("lang").alias("path"), "kind", "name", "exported", F.array("source", "name").alias("keywords"))
    return modules.summaries(rows).select("path", "chunks", *(F.array_join(c, ",").alias(c) for c in ("kinds", "keywords", "exports")))


@query(f"SELECT module, chunk_id, rank FROM (SELECT module, doc_id AS chunk_id, row_number() OVER (PARTITION BY module ORDER BY length(text) DESC, doc_id)::INT AS rank FROM ({_CHUNKS})) WHERE rank <= 5")
def module_topk(t):
    rows = _chunks(t).select("module", F.col("doc_id").alias("chunk_id"), F.length("text").alias("score"))
    return modules.top_per_module(rows, 5).select("module", "chunk_id", F.col("module_rank").alias("rank"))
