"""Literals, vocabulary, paths, fusion, hybrid ranking, incremental index, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring, text as tx
from ..operators import chunking, incremental, lexical, paths, ranking
from .lexical_queries import BM25, TOKENS, WORDS
from .registry import query

_PATH = "source || '/' || lang || '/doc_' || doc_id || '.md'"
#: part names as camel-case identifiers: `cold widget` is coldWidget.
_CAMEL = "lower(substr(p_name, 1, 1)) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')[2:]"
_WORDS = "list_filter(string_split(lower(regexp_replace(regexp_replace(ident, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[-_\\s]+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


def _path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".md"))


def _camel():
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    whole = F.array_join(words, "")
    return F.concat(F.lower(F.substr(whole, F.lit(1), F.lit(1))), F.substr(whole, F.lit(2)))


def _idents(t):
    return t.part.select(F.col("p_partkey").alias("id"), _camel().alias("ident"))


_IDENTS = f"SELECT p_partkey AS id, {_CAMEL} AS ident FROM part"


@query(f"SELECT DISTINCT id, unnest({_WORDS}) AS word FROM ({_IDENTS})")
def identifier_split(t):
    return _idents(t).select("id", F.explode(tx.vocabulary(F.col("ident"))).alias("word"))


@query(f"SELECT id, ident, regexp_matches(ident, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$') AS is_identifier FROM ({_IDENTS})")
def identifier_query(t):
    return _idents(t).select("id", "ident", tx.is_identifier(F.col("ident")).alias("is_identifier"))


@query(f"SELECT DISTINCT ident FROM ({_IDENTS})")
def identifiers_extract(t):
    return _idents(t).select(F.explode(F.regexp_extract_all("ident", F.lit(r"[a-zA-Z_]\w{2,}"), F.lit(0))).alias("ident")).distinct()


_LITERAL = "WITH q AS (SELECT ident AS lit FROM (" + _IDENTS + ") ORDER BY id LIMIT 3)"


def _literals(t):
    """The first three parts' identifiers, as a query's literals."""
    return F.broadcast(_idents(t).orderBy("id").limit(3).select(F.lower("ident").alias("key"), F.col("ident").alias("lit")).distinct())


@query(f"{_LITERAL} SELECT DISTINCT id, ident, (ident = lit) AS exact FROM ({_IDENTS}) i JOIN (SELECT DISTINCT lit FROM q) q ON lower(ident) = lower(lit)")
def literal_match(t):
    return _idents(t).withColumn("key", F.lower("ident")).join(_literals(t), "key").select("id", "ident", (F.col("ident") == F.col("lit")).alias("exact"))


@query(f"{_LITERAL} SELECT id, CASE WHEN ident IN (SELECT lit FROM q) THEN CASE WHEN id % 3 = 0 THEN 1.0::DOUBLE ELSE round((id % 3) / 10.0::DOUBLE * 2.0::DOUBLE, 6) END ELSE round((id % 3) / 10.0::DOUBLE, 6) END AS score FROM ({_IDENTS})")
def literal_boost(t):
    hit = _idents(t).withColumn("key", F.lower("ident")).join(_literals(t), "key", "left")
    mult = F.when(F.col("lit").isNotNull(), scoring.LITERAL["definition", "medium"]).otherwise(1.0)
    return hit.select("id", F.round(scoring.literal_boost((F.col("id") % 3) / 10.0, mult), 6).alias("score"))


@query(f"{_LITERAL} SELECT id FROM ({_IDENTS}) WHERE ident IN (SELECT lit FROM q) AND id % 2 = 1")
def literal_only(t):
    processed = _idents(t).where("id % 2 = 0").select("id")
    return _idents(t).withColumn("key", F.lower("ident")).join(_literals(t), "key", "left_semi").join(processed, "id", "left_anti").select("id")


_VOCAB = f"SELECT id, len(list_intersect(list_distinct({_WORDS}), ['cold', 'widget', 'large']))::BIGINT AS matched FROM ({_IDENTS})"


@query(f"SELECT id, matched, round(matched / 3.0::DOUBLE, 6) AS score FROM ({_VOCAB}) WHERE matched > 0")
def vocab_overlap(t):
    df = lexical.vocabulary_overlap(_idents(t), ["cold", "widget", "large"], "id", "ident")
    return df.withColumn("score", F.round("score", 6))


@query(f"SELECT id, CASE WHEN matched >= 2 THEN round(1.3::DOUBLE + least((matched - 2) * 0.1::DOUBLE, 0.5::DOUBLE), 6) ELSE 1.0::DOUBLE END AS multiplier FROM ({_VOCAB})")
def vocab_multiplier(t):
    n = F.size(F.array_intersect(tx.vocabulary(F.col("ident")), F.array(*map(F.lit, ["cold", "widget", "large"]))))
    return _idents(t).select("id", F.round(F.when(n >= 2, 1.3 + F.least((n - 2) * 0.1, F.lit(0.5))).otherwise(1.0), 6).alias("multiplier"))


_LEXICON = [("auth", 0, "authentication", "strong"), ("auth", 1, "login", "moderate"), ("auth", 2, "session", "weak"), ("db", 0, "database", "strong"), ("db", 1, "storage", "moderate")]


@query("WITH l(term, ord, synonym, grade) AS (VALUES " + ", ".join(map(str, _LEXICON)) + "), q AS (SELECT unnest(['auth', 'flow', 'db']) AS term, unnest([0, 1, 2]) AS pos), x AS (SELECT term, 1.0::DOUBLE AS weight, pos AS o, -1 AS p FROM q UNION ALL SELECT synonym, CASE grade WHEN 'strong' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END, 100 + pos, ord FROM q JOIN l USING (term) WHERE grade <> 'weak') SELECT term, weight FROM (SELECT *, row_number() OVER (ORDER BY o, p) AS r FROM x) WHERE r <= 6")
def synonym_expand(t):
    words = t.spark.createDataFrame([("auth", 0), ("flow", 1), ("db", 2)], "term string, pos int")
    lex = t.spark.createDataFrame(_LEXICON, "term string, ord int, synonym string, grade string")
    return incremental.expand(words, lex, 6)


@query("WITH u AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1) AS path FROM pages) SELECT page_id, path, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::INT AS depth FROM u")
def path_context(t):
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1)
    return t.pages.select("page_id", path.alias("path")).withColumn("depth", F.size(tx.path_segments(F.col("path"))))


@query(f"SELECT doc_id, CASE WHEN lang <> 'xx' AND (contains(source, 'src1') OR contains('src1', source) OR contains(source, 'french') OR contains('french', source) OR contains(lang, 'src1') OR contains('src1', lang) OR contains(lang, 'french') OR contains('french', lang)) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(source, 'src1') OR contains('src1', source) OR contains(source, 'french') OR contains('french', source) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM documents")
def path_boost(t):
    return t.documents.select("doc_id", F.round(paths.boost(_path(), ["src1", "french"]), 6).alias("boost"))


@query(f"SELECT doc_id FROM documents WHERE contains({_PATH}, '_1.md') OR contains({_PATH}, '/fr/')")
def file_pattern_filter(t):
    return t.documents.where(paths.fits_pattern(_path(), ["_1.md", "/fr/"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en'")
def path_prefix_filter(t):
    return t.documents.where(paths.fits_filter(_path(), "./src3/en/")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source LIKE 'src1%' AND lang IN ('de', 'fr')")
def path_glob_filter(t):
    return t.documents.where(paths.fits_filter(_path(), "src1*/{de,fr}/*.md")).select("doc_id")


@query(f"SELECT {_PATH} AS path, CASE WHEN lang = 'en' THEN source || '-en' ELSE source END AS project FROM documents")
def project_prefix_join(t):
    roots = t.documents.select("source").distinct()
    roots = roots.select(F.col("source").alias("root"), F.col("source").alias("name")).union(roots.select(F.concat("source", F.lit("/en")), F.concat("source", F.lit("-en"))))
    return paths.longest_prefix(t.documents.select(_path().alias("path")), roots)


@query("SELECT event_id, 'props.' || unnest(json_keys(props)) AS path FROM events")
def json_paths(t):
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.explode(keys).alias("k")).select("event_id", F.concat(F.lit("props."), "k").alias("path"))


@query("SELECT l.id, line, start_line FROM (SELECT doc_id AS id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) l JOIN (SELECT doc_id AS id, unnest(range(0, greatest(len(string_split(text, chr(10))) - 11, 0) + 1, 40)) + 1 AS start_line, len(string_split(text, chr(10))) AS n FROM documents) c ON l.id = c.id AND line BETWEEN start_line AND least(start_line + 49, n)")
def symbols_in_chunks(t):
    c = chunking.line_chunks(t.documents, "doc_id", "text", 50, 10).select("id", "start_line", "end_line")
    lines = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n", -1)))).alias("line"))
    return lines.join(c, "id").where("line BETWEEN start_line AND end_line").select("id", F.col("line").cast("long"), F.col("start_line").cast("long"))


_HYBRID = f"""WITH {BM25},
r AS (SELECT id, CASE WHEN row_number() OVER (ORDER BY bm25 DESC, id) <= 30 THEN 1 / (1 + exp(-bm25 / 3 + 1)) ELSE 0 END AS b FROM b),
i AS (SELECT f.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM f, s),
m AS (SELECT * FROM i WHERE idf >= (SELECT median(idf) FROM i)),
g AS (SELECT doc_id AS id, sum(idf) AS got FROM documents, m WHERE contains(lower(text), term) OR (term = 'thand' AND regexp_matches(lower(text), '(^|[^0-9a-z_])than([^0-9a-z_]|$)')) GROUP BY doc_id),
v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS cos FROM embeddings),
x AS (SELECT doc_id AS id, coalesce(cos, 0) AS cos, coalesce(r.b, 0) AS b, coalesce(got, 0) / (SELECT sum(idf) FROM m) AS share,
      (contains(lower(text), 'de')::INT + contains(lower(text), 'la')::INT + contains(lower(text), 'that')::INT + contains(lower(text), 'thand')::INT + contains(lower(text), 'the')::INT)::DOUBLE / 5 AS coverage,
      contains(lower(text), '{WORDS}') AS phrase
      FROM documents d LEFT JOIN v ON v.id = doc_id LEFT JOIN r ON r.id = doc_id LEFT JOIN g ON g.id = doc_id),
y AS (SELECT *, CASE WHEN phrase THEN 0.5::DOUBLE WHEN coverage >= 0.8 THEN 0.2::DOUBLE WHEN coverage >= 0.6 THEN 0.1::DOUBLE ELSE 0 END AS ph FROM x),
z AS (SELECT *, (0.62::DOUBLE * cos + 0.33::DOUBLE * b + ph + 0.1::DOUBLE * share) * greatest(0.72::DOUBLE, 1 - 0.16::DOUBLE * (1 - share)) AS score,
      least(1, greatest(0, (cos + 1) / 2)) AS semantic, least(1, greatest(0, 0.33::DOUBLE * b + least(0.2::DOUBLE, 0.15::DOUBLE * coverage))) AS structured FROM y),
h AS (SELECT id, score, semantic, structured FROM z WHERE score >= 0.15 OR b > 0.3 OR ph >= 0.2)"""


def _hits(t):
    probe = [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]
    return ranking.hybrid(t.documents.select("doc_id", "text"), t.embeddings, WORDS, probe)


def _shown(df):
    return df.select("id", "rank", *(F.round(c, 6).alias(c) for c in ("score", "semantic", "structured")))


def _ranked_sql(*keys: str) -> str:
    by = ", ".join(f"round({k}, 9) DESC" for k in keys)
    return f"{_HYBRID} SELECT id, rank::INT AS rank, round(score, 6) AS score, round(semantic, 6) AS semantic, round(structured, 6) AS structured FROM (SELECT *, row_number() OVER (ORDER BY {by}, id) AS rank FROM h) WHERE rank <= 10"


@query(f"{_HYBRID} SELECT id, round(score, 6) AS score, round(semantic, 6) AS semantic, round(structured, 6) AS structured FROM h")
def hybrid_docs(t):
    return _hits(t).select("id", *(F.round(c, 6).alias(c) for c in ("score", "semantic", "structured")))


@query(_ranked_sql("structured", "semantic", "score"))
def hybrid_rank_structured(t):
    return _shown(ranking.ranked(_hits(t), "structured", 10))


@query(_ranked_sql("semantic", "structured", "score"))
def hybrid_rank_semantic(t):
    return _shown(ranking.ranked(_hits(t), "semantic", 10))


@query(_ranked_sql("score"))
def hybrid_rank_combined(t):
    return _shown(ranking.ranked(_hits(t), "combined", 10))


@query(f"{_HYBRID}, e AS (SELECT doc_id AS id FROM documents WHERE contains(text, 'thand') ORDER BY {_PATH} LIMIT 20) SELECT h.id, round(CASE WHEN e.id IS NULL THEN score ELSE score * 1.5 END, 6) AS score, round(least(1, CASE WHEN e.id IS NULL THEN structured ELSE structured * 1.5 END), 6) AS structured, e.id IS NOT NULL AS exact FROM h LEFT JOIN e USING (id)")
def fusion_boost(t):
    exact = t.documents.where(F.contains("text", F.lit("thand"))).orderBy(_path()).limit(20).select(F.col("doc_id").alias("id"))
    df = ranking.fused(_hits(t), exact)
    return df.select("id", F.round("score", 6).alias("score"), F.round("structured", 6).alias("structured"), "exact")


@query("SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.toxic = 1 THEN 'changed' ELSE 'touched' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status")
def changed_files(t):
    now = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    old = t.labels.join(t.documents, "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("toxic") == 1, "other").otherwise(F.sha2("text", 256)).alias("hash"))
    return incremental.changes(now, old).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id::VARCHAR AS path FROM labels WHERE doc_id % 2 = 1")
def stale_files(t):
    now = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"))
    return incremental.stale(now, t.labels.select(F.col("doc_id").cast("string").alias("path")))


@query("SELECT lang AS module_id, count(*)::BIGINT AS files, sum(greatest(ceil((len(string_split(text, chr(10))) - 10) / 40.0), 1))::BIGINT AS chunks FROM documents GROUP BY lang")
def manifest_status(t):
    c = chunking.line_chunks(t.documents, "doc_id", "text", 50, 10).groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("module_id")).join(c, "id").groupBy("module_id").agg(F.count(F.lit(1)).alias("files"), F.sum("c").alias("chunks"))


@query("WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS stop, count(*)::BIGINT AS n FROM g GROUP BY user_id, k")
def debounce_sessions(t):
    return incremental.sessions(t.events, "10 minutes")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id")
def coalesce_last_event(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(t):
    df = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return df.select(F.col("w.start").alias("start"), "event_type", "n", "total")


_GOLD = f"""WITH {BM25}, gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def golden_labels(t):
    return incremental.containing(t.documents, t.benchmark)


@query("WITH g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank, doc_id % 2 AS odd FROM g) SELECT round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT item_id, min(CASE WHEN odd = 1 THEN rank END) AS first FROM r GROUP BY item_id)")
def golden_metrics(t):
    hits = incremental.containing(t.documents, t.benchmark)
    w = Window.partitionBy("item_id").orderBy("doc_id")
    found = hits.withColumn("rank", F.row_number().over(w)).withColumn("relevant", F.col("doc_id") % 2 == 1)
    return incremental.retrieval_metrics(found, 10)


@query(f"{_HYBRID}, ws AS (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS w), k AS (SELECT ws.w, id, row_number() OVER (PARTITION BY ws.w ORDER BY round(ws.w * cos + (1 - ws.w) * b, 9) DESC, id) AS rank FROM z, ws) SELECT w, id FROM k WHERE rank <= 5")
def weight_sweep(t):
    probe = [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]
    df = ranking.hybrid(t.documents.select("doc_id", "text"), t.embeddings, WORDS, probe, min_score=-10.0)
    return incremental.sweep(df, [0.2, 0.5, 0.8], 5)
