"""Keywords, file types, introspection, symbols and code chunks; the tables have no code, so it is composed of their names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keywords, text as tx
from ..operators import code, introspection, paths
from ..streaming import refresh
from .registry import query


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(cases) -> str:
    return "CASE " + " ".join(f"WHEN {fits} THEN '{value}'" for fits, value in cases) + " END"


_TOKENS = "regexp_extract_all(lower(text), '\\w{2,}')"


@query(f"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_filter(w, lambda x: NOT list_contains(['a','an','the','in','on','at','to','for','of','with','by','from','as','and','or','but','what','where','when','how','why','which','who','is','are','was','were','be','been','being','have','has','had','do','does','did','i','you','he','she','it','we','they','this','that','these','those'], x)))::BIGINT AS n_kept FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def stopword_tokens(t):
    w = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(tx.without_stop_words(w)).cast("long").alias("n_kept"))


@query("SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: length(x) > 2)) AS term FROM conversations")
def query_terms(t):
    return t.conversations.select("conv_id", "turn", F.explode(tx.query_terms(F.col("text"))).alias("term"))


#: Folders and extensions that paths are composed of.
FOLDERS = ["src/api/users", "apps/web/components", "lib/orders-core", "tests/e2e", "packages/billing/models", "server/authsession/helpers", "plain"]
EXTENSIONS = ["ts", "jsx", "py", "go", "rs", "md", "json", "yml", "xyz", "hpp"]
_FILE = f"{_listed(FOLDERS)}[(c_custkey % {len(FOLDERS)} + 1)::INT] || '/' || lower(c_mktsegment) || c_custkey || '.' || {_listed(EXTENSIONS)}[(c_custkey % {len(EXTENSIONS)} + 1)::INT]"
_FILES = f"SELECT c_custkey AS id, {_FILE} AS path, CASE WHEN c_custkey % 3 = 0 THEN 'webshop' WHEN c_custkey % 3 = 1 THEN 'root' ELSE 'zz-tools' END AS project FROM customer"


def _files(t):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % len(words) + 1).cast("int"))
    path = F.concat(pick(FOLDERS), F.lit("/"), F.lower("c_mktsegment"), "c_custkey", F.lit("."), pick(EXTENSIONS))
    kind = F.col("c_custkey") % 3
    project = F.when(kind == 0, "webshop").when(kind == 1, "root").otherwise("zz-tools")
    return t.customer.select(F.col("c_custkey").alias("id"), path.alias("path"), project.alias("project"))


_EXT = "regexp_extract(path, '[^/](\\.[^./]*)$', 1)"


@query(f"SELECT id, {_case([(f'list_contains({_listed(e)}, {_EXT})', name) for name, e in introspection.LANGUAGES.items()])} AS language FROM ({_FILES})")
def file_language(t):
    return _files(t).select("id", introspection.language(F.col("path")).alias("language"))


@query(
    f"SELECT id, CASE WHEN list_contains({_listed(keywords.CODE_EXTENSIONS)}, {_EXT}) THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END AS code_boost,"
    f" CASE WHEN list_contains({_listed(keywords.DOC_EXTENSIONS)}, {_EXT}) THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS doc_boost, 0.0::DOUBLE AS no_boost FROM ({_FILES})"
)
def file_type_boost(t):
    boosts = {"code_boost": ["login", "handler"], "doc_boost": ["handler", "guide"], "no_boost": ["login"]}
    return _files(t).select("id", *(keywords.file_type_boost(F.col("path"), terms).alias(name) for name, terms in boosts.items()))


_LAYERS = introspection.LAYERS.items()
_PARTS = f"SELECT id, project, string_split(lower(path), '/') AS s FROM ({_FILES})"
_TOLD = (
    "SELECT id, project, s, coalesce("
    + _case([(f"regexp_matches(s[-1], '{'|'.join(w)}')", k) for k, w in _LAYERS])
    + ", list_filter(list_transform(list_reverse(s[:-2]), lambda x: "
    + _case([(f"list_contains({_listed(w)}, x)", k) for k, w in _LAYERS])
    + "), lambda x: x IS NOT NULL)[1]) AS layer, list_filter(list_transform(s, lambda x: CASE WHEN list_contains("
    + f"{_listed(introspection.NO_DOMAIN)}, x) THEN NULL WHEN list_contains({_listed(introspection.DOMAINS)}, x) THEN x ELSE "
    + _case([(f"starts_with(x, '{d}') OR ends_with(x, '{d}')", d) for d in introspection.DOMAINS])
    + f" END), lambda x: x IS NOT NULL)[1] AS domain FROM ({_PARTS})"
)
_SCOPE = (
    "coalesce("
    + _case([(f"regexp_matches(project, '{'|'.join(w)}')", k) for k, w in introspection.SCOPE_NAMES.items()])
    + ", "
    + _case([(f"list_contains({_listed(w)}, layer)", k) for k, w in introspection.SCOPE_LAYERS.items()])
    + ", list_filter(list_transform(s, lambda x: "
    + _case([(f"list_contains({_listed(w)}, x)", k) for k, w in introspection.SCOPE_FOLDERS.items()])
    + "), lambda x: x IS NOT NULL)[1], 'unknown')"
)


@query(f"SELECT id, layer, domain, {_SCOPE} AS scope, len(s)::BIGINT - 1 AS depth FROM ({_TOLD})")
def introspect_files(t):
    p = F.col("path")
    told = [introspection.layer(p).alias("layer"), introspection.domain(p).alias("domain"), introspection.scope(p, F.col("project")).alias("scope")]
    return _files(t).select("id", *told, (F.size(introspection.segments(p)) - 1).cast("long").alias("depth"))


def _near(c: str, terms: list[str], both: bool) -> str:
    return "coalesce(" + " OR ".join(f"contains({c}, '{x}')" + (f" OR contains('{x}', {c})" if both else "") for x in terms) + ", false)"


_TERMS = ["users", "api", "web"]


@query(
    f"SELECT id, round((CASE WHEN {_near('domain', _TERMS, True)} THEN 1.1::DOUBLE ELSE 1 END) * (CASE WHEN {_near('layer', _TERMS, True)} THEN 1.05::DOUBLE ELSE 1 END)"
    f" * (CASE WHEN {_SCOPE} = 'backend' THEN 1.05::DOUBLE ELSE 1 END) * pow(1.03::DOUBLE, len(list_filter(s[:-2], lambda x: {_near('x', _TERMS, False)})))"
    f" * (CASE WHEN project <> 'root' AND {_near('project', _TERMS, False)} THEN 1.05::DOUBLE ELSE 1 END), 6) AS boost FROM ({_TOLD})"
)
def introspection_boost(t):
    return _files(t).select("id", F.round(introspection.boost(F.col("path"), F.col("project"), _TERMS), 6).alias("boost"))


@query(f"SELECT id, CASE WHEN string_split(path, '/')[1] = 'src' THEN 'src/api' ELSE NULL END AS nearest FROM ({_FILES})")
def nearest_ancestor(t):
    files = _files(t).select("id", "path")
    roots = files.where(F.startswith("path", F.lit("src/api/"))).select(F.lit("src/api").alias("root"), F.lit("src/api").alias("name")).distinct()
    near = paths.longest_prefix(files.select("path"), roots)
    return files.join(near, "path", "left").select("id", F.col("project").alias("nearest"))


@query("SELECT p_partkey AS id, round((CASE p_size % 7 WHEN 1 THEN 0.01::DOUBLE WHEN 2 THEN 0.02 WHEN 3 THEN 0.03 WHEN 0 THEN 0.0 ELSE 0.05 END) * (0.25::DOUBLE + 0.75::DOUBLE * (p_partkey % 11) / 10), 6) AS boost FROM part")
def heading_boost(t):
    boost = keywords.heading_boost(F.col("p_size") % 7, (F.col("p_partkey") % 11) / 10)
    return t.part.select(F.col("p_partkey").alias("id"), F.round(boost, 6).alias("boost"))


@query("SELECT DISTINCT p_partkey AS id, unnest(list_concat(string_split(lower(p_name), ' '), [lower(p_brand)], [lower(p_type)], ['see', 'code_' || p_size])) AS word FROM part")
def markdown_keywords(t):
    md = F.concat(F.lit("## a "), "p_name", F.lit("\n*"), "p_type", F.lit("* is `"), "p_brand", F.lit("` [see](x) **code_"), "p_size", F.lit("**"))
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(keywords.markdown(md)).alias("word"))


@query("SELECT DISTINCT event_id, unnest(['k', 'eventkind', 'event', 'kind', 'list'] || list_filter(string_split_regex(lower(event_type), '[ _./-]+'), lambda x: length(x) > 2)) AS word FROM events")
def json_keywords(t):
    whole = F.concat(F.lit('{"list": ['), "props", F.lit('], "eventKind": "'), "event_type", F.lit('"}'))
    return t.events.select("event_id", F.explode(keywords.json_words(whole)).alias("word"))


_NAME = "replace(p_name, ' ', '_') || p_partkey"


def _code(t):
    n = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey")
    lines = [F.concat(F.lit("export class K_"), n, F.lit(" {")), F.lit('  a = "}";'), F.lit("}"), F.lit("// note"), F.concat(F.lit("function f_"), n, F.lit("(x) {")), F.lit("  return x; // }"), F.lit("}"), F.concat(F.lit("type T_"), n, F.lit(" = string;"))]
    return t.part.select(F.col("p_partkey").alias("id"), n.alias("n"), F.array_join(F.array(*lines), "\n").alias("code"), F.lit("typescript").alias("lang"))


_NAMED = f"SELECT p_partkey AS id, {_NAME} AS n FROM part"


@query(
    f"SELECT id, 'K_' || n AS name, 'class' AS kind, 1::BIGINT AS line, true AS exported FROM ({_NAMED}) UNION ALL SELECT id, 'f_' || n, 'function', 5, false FROM ({_NAMED})"
    f" UNION ALL SELECT id, 'T_' || n, 'type', 8, false FROM ({_NAMED})"
)
def symbols_extract(t):
    return code.symbols(_code(t), "id", "code")


@query(
    f"SELECT id, 'file' AS kind, NULL::VARCHAR AS name, 1::BIGINT AS start_line, 8::BIGINT AS end_line, false AS exported FROM ({_NAMED}) UNION ALL SELECT id, 'class', 'K_' || n, 1, 3, true FROM ({_NAMED})"
    f" UNION ALL SELECT id, 'function', 'f_' || n, 5, 7, false FROM ({_NAMED}) UNION ALL SELECT id, 'type', 'T_' || n, 8, 8, false FROM ({_NAMED})"
)
def code_chunks(t):
    return code.chunks(_code(t), "id", "code", "lang").drop("doc", "content")


@query(f"SELECT path AS id, 'up/' || id || '.ts' AS target FROM (SELECT id, 'top/in/' || n || '.ts' AS path FROM ({_NAMED})) UNION ALL SELECT path, 'top/in/x/' || id FROM (SELECT id, 'top/in/' || n || '.ts' AS path FROM ({_NAMED}))")
def references_resolve(t):
    text = F.concat(F.lit("import a from '../../up/"), "id", F.lit(".ts';\nimport b from 'pkg';\nconst c = require(\"./x/"), "id", F.lit('")'))
    return code.references(_code(t).select(F.concat(F.lit("top/in/"), "n", F.lit(".ts")).alias("path"), text.alias("text")), "path", "text")


@query(
    "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 5 MINUTES, ts), time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 5 MINUTES]) AS start FROM events)"
    " SELECT event_type, start, count(*)::BIGINT AS n FROM w GROUP BY ALL"
)
def sliding_windows(t):
    return refresh.sliding(t.events, "10 minutes", "5 minutes", "10 minutes")


_DOCS_TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\w{2,}')) AS term FROM documents"


@query(f"WITH k AS ({_DOCS_TERMS}), l AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM k WHERE doc_id NOT IN (SELECT doc_id FROM l) GROUP BY term")
def term_statistics_after_deltas(t):
    docs = t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("path"))
    nothing, gone = docs.limit(0), docs.join(toxic, "path", "left_semi")
    return refresh.apply_deltas(refresh.term_deltas(nothing, docs), refresh.term_deltas(gone, nothing))
