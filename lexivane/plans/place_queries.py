"""Places of files, sections, JSON paths, stored search and the golden queries; their SQL has its own lists, written by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import json_paths as jp
from ..operators import chunking, incremental, paths, search, structure
from .code_queries import _FILES, _files
from .lexical_queries import TOKENS
from .registry import query

# -- places ------------------------------------------------------------------------------------------
# Paths are one of seven folders, a segment's name with the key, and one of ten extensions.

_BARE = f"SELECT id, path, project, regexp_replace(path, '\\.[^.]+$', '') AS bare FROM ({_FILES})"
_COMMON = "['const','let','var','function','class','interface','type','enum','export','import','from','return','async','await','new','this','true','false','null','undefined','if','else','for','while','switch','case','break','continue','try','catch','finally','throw','typeof','instanceof','void','delete','in','of','string','number','boolean','any','unknown','never','object','public','private','protected','static','readonly','abstract','implements','extends','super','get','set','constructor','the','and','for','not','with','are','was','has','have']"
_WORDS_OF = "list_concat([lower(s)], string_split(lower(regexp_replace(s, '[_-]', ' ', 'g')), ' '))"
_KEYWORDS = f"SELECT id, path, list_filter(flatten(list_transform(string_split(bare, '/'), lambda s: {_WORDS_OF})), lambda w: length(w) > 2 AND NOT list_contains({_COMMON}, w)) AS words FROM ({_BARE})"


@query(f"SELECT DISTINCT id, unnest(words) AS word FROM ({_KEYWORDS})")
def path_keywords(t):
    return _files(t).select("id", F.explode(structure.path_keywords(F.col("path"))).alias("word"))


@query(f"SELECT DISTINCT id, word FROM (SELECT id, unnest(words) AS word FROM ({_KEYWORDS})) WHERE word NOT IN ('src', 'lib', 'app', 'index', 'dist', 'build', 'out', 'node_modules')")
def summary_path_keywords(t):
    return _files(t).select("id", F.explode(structure.summary_keywords(F.col("path"))).alias("word"))


#: What each of the seven folders tells: layer, domain, and the text before a chunk.
_FOLDER = "(VALUES ('src/api/users', 'controller', 'users', '[users controller api]'), ('apps/web/components', 'presentation', 'web', '[web presentation apps components]'), ('lib/orders-core', NULL, 'orders-core', '[orders-core]'), ('tests/e2e', 'test', 'e2e', '[e2e test tests]'), ('packages/billing/models', 'model', 'billing', '[billing model packages models]'), ('server/authsession/helpers', 'util', 'authsession', '[authsession util server helpers]'), ('plain', NULL, 'plain', '[plain]')) f(folder, layer, domain, context)"
_PLACED = f"""SELECT id, path, bare, project, folder, domain, name, CASE WHEN ui AND (layer IS NULL OR layer = 'test') THEN 'presentation' ELSE layer END AS layer,
 CASE WHEN ui AND layer = 'test' THEN '[e2e presentation tests]' WHEN ui AND layer IS NULL THEN replace(context, ']', ' presentation]') ELSE context END AS context
 FROM (SELECT *, regexp_extract(bare, '[^/]+$') AS name, contains(regexp_extract(bare, '[^/]+$'), 'ui') AS ui FROM ({_BARE}) JOIN {_FOLDER} ON starts_with(path, folder || '/'))"""


@query(f"SELECT id, layer, domain, (len(string_split(folder, '/')))::INT AS depth FROM ({_PLACED})")
def path_contexts(t):
    told = _files(t).select("id", structure.path_context(F.col("path")).alias("c"))
    return told.select("id", "c.layer", "c.domain", "c.depth")


@query(f"SELECT id, context FROM ({_PLACED})")
def context_texts(t):
    return _files(t).select("id", structure.context_text(F.col("path")).alias("context"))


@query(f"SELECT id, context || ' ' || name || ' ' || project || ': ' || CASE WHEN id % 2 = 0 THEN 'a doc ' ELSE '' END || 'body' AS text FROM ({_PLACED})")
def embedding_texts(t):
    doc = F.when(F.col("id") % 2 == 0, "a doc")
    return _files(t).select("id", structure.embedding_text(F.col("path"), F.lit("body"), F.col("project"), doc).alias("text"))


#: Files with a README beside them: two kinds in one folder, one in the root of the packages, and none above the others.
_READMES = ["src/readme.md", "src/README.md", "packages/index.md", "tests/e2e/INDEX.md"]


@query(f"SELECT id, CASE WHEN folder = 'src/api/users' THEN 'src/README.md' WHEN folder = 'packages/billing/models' THEN 'packages/index.md' WHEN folder = 'tests/e2e' THEN 'tests/e2e/INDEX.md' END AS readme FROM ({_PLACED})")
def nearest_readme(t):
    files = _files(t).select("id", "path")
    more = t.spark.createDataFrame([(p,) for p in _READMES], "path string")
    return files.join(structure.nearest_readme(files.select("path").union(more)), "path").select("id", "readme")


def _tree(t):
    """The files, and manifests that tell projects; one isn't JSON."""
    rows = [("apps/web/package.json", '{"name": "@x/web", "dependencies": {"react": "1"}}'), ("server/package.json", '{"devDependencies": {"express": "4"}}'), ("lib/package.json", '{"main": "a.js"}'), ("tests/package.json", "{no"), ("package.json", "{}")]
    return _files(t).select("path", F.lit("").alias("content")).union(t.spark.createDataFrame(rows, "path string, content string"))


_PROJECTS = "(VALUES ('apps/web', '@x/web', 'app'), ('packages/billing', 'billing', 'library'), ('server', 'server', 'service'), ('lib', 'lib', 'library')) p(root, name, type)"


@query(f"SELECT * FROM {_PROJECTS}")
def project_detection(t):
    return structure.projects(_tree(t))


@query(f"SELECT id, coalesce(name, 'root') AS project, coalesce(root, '') AS root, coalesce(type, 'unknown') AS type FROM ({_FILES}) f LEFT JOIN {_PROJECTS} ON starts_with(f.path, root || '/')")
def project_of_files(t):
    files = _files(t).select("id", "path")
    return files.join(structure.project_of(files, structure.projects(_tree(t))), "path").select("id", "project", "root", "type")


@query(f"SELECT id, CASE WHEN starts_with(path, 'apps/web/') THEN 'shared' WHEN starts_with(path, 'tests/') THEN 'tooling' ELSE 'unknown' END AS scope, CASE WHEN starts_with(path, 'apps/web/') THEN 'vue' ELSE 'none' END AS framework FROM ({_FILES})")
def project_overrides(t):
    rows = _files(t).select("id", "path", F.lit("").alias("root"), F.lit("unknown").alias("scope"), F.lit("none").alias("framework"))
    told = structure.overridden(rows, [("apps/web", "shared", "vue"), ("tests", "tooling", None), ("apps", "backend", "x")])
    return told.select("id", "scope", "framework")


#: Paths of several conventions each, composed of a key.
_CONV = "SELECT c_custkey AS id, ['auth', 'src', 'cmd'][(c_custkey % 3 + 1)::INT] AS dir, ['index.ts', 'main.go', '__init__.py', 'user.types.ts', 'login.test.ts', 'package.json', 'a.d.ts', 'plain.txt'][(c_custkey % 8 + 1)::INT] AS name FROM customer"


def _conv(t):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % len(words) + 1).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("types/"), pick(["auth", "src", "cmd"]), F.lit("/"), pick(["index.ts", "main.go", "__init__.py", "user.types.ts", "login.test.ts", "package.json", "a.d.ts", "plain.txt"])).alias("path"))


@query(f"""SELECT DISTINCT id, unnest(list_concat(['types', 'definitions'], CASE name
 WHEN 'index.ts' THEN list_concat(['entry', 'barrel', 'exports', 'module'], CASE WHEN dir = 'src' THEN [] ELSE [dir] END)
 WHEN 'main.go' THEN list_concat(['entry', 'main', 'go', 'golang', 'entrypoint'], CASE WHEN dir = 'auth' THEN [dir] ELSE [] END)
 WHEN '__init__.py' THEN list_concat(['entry', 'package', 'init', 'python', 'module'], CASE WHEN dir = 'src' THEN [] ELSE [dir] END)
 WHEN 'user.types.ts' THEN ['typescript', 'interfaces', 'user']
 WHEN 'login.test.ts' THEN ['test', 'spec', 'unit test', 'login']
 WHEN 'package.json' THEN ['package', 'dependencies', 'npm', 'scripts', 'manifest', 'node']
 WHEN 'a.d.ts' THEN ['declarations', 'typescript'] ELSE [] END)) AS word FROM ({_CONV})""")
def convention_keywords(t):
    return _conv(t).select("id", F.explode(structure.convention_keywords(F.col("path"))).alias("word"))


@query(f"""SELECT id, unnest(list_concat(CASE name WHEN 'index.ts' THEN ['index-file'] WHEN 'main.go' THEN ['go-main'] WHEN '__init__.py' THEN ['python-init'] WHEN 'package.json' THEN ['package-json'] WHEN 'a.d.ts' THEN ['dts-file'] WHEN 'user.types.ts' THEN ['types-file'] ELSE [] END,
 ['types-folder'], CASE name WHEN 'login.test.ts' THEN ['test-file'] ELSE [] END)) AS convention FROM ({_CONV})""")
def convention_matches(t):
    return _conv(t).select("id", F.explode(structure.conventions(F.col("path"))).alias("c")).select("id", F.col("c.id").alias("convention"))


@query(f"SELECT id, list_contains(w, name) AS has_name, list_contains(w, 'users') AS has_users, list_contains(w, 'webshop') AS has_project FROM (SELECT id, name, list_concat([name], CASE WHEN folder = 'src/api/users' THEN ['users'] ELSE [] END, CASE WHEN project = 'webshop' THEN ['webshop'] ELSE [] END) AS w FROM ({_PLACED}))")
def introspection_words(t):
    words = structure.introspection_keywords(F.col("path"), F.col("project"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return _files(t).withColumn("w", words).select("id", F.array_contains("w", name).alias("has_name"), F.array_contains("w", "users").alias("has_users"), F.array_contains("w", "webshop").alias("has_project"))


@query(f"SELECT id FROM ({_FILES}) WHERE starts_with(path, 'plain/') OR contains(path, '/web/') OR ends_with(path, '.rs')")
def exact_path_filter(t):
    return _files(t).where(paths.fits_exact(F.col("path"), ["plain/", "web", "*.rs"])).select("id")


# -- sections ----------------------------------------------------------------------------------------

#: A text with nested headings: some with a preamble, some plain.
_MD = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'intro ' || p_name || chr(10) WHEN p_partkey % 3 = 1 THEN '' END || '# ' || p_type || chr(10) || 'a' || chr(10) || '## Two' || chr(10) || 'b' || chr(10) || '### Three' || chr(10) || '##### Five' || chr(10) || '## Other' || chr(10) || 'c' AS md, (p_partkey % 3 = 0)::INT AS o, p_name, p_type FROM part"


def _markdown(t):
    kind, n = F.col("p_partkey") % 3, F.lit("\n")
    before = F.when(kind == 0, F.concat(F.lit("intro "), "p_name", n)).when(kind == 1, "")
    whole = F.concat(before, F.lit("# "), "p_type", F.lit("\na\n## Two\nb\n### Three\n##### Five\n## Other\nc"))
    return t.part.select(F.col("p_partkey").alias("id"), F.coalesce(whole, F.concat(F.lit("no heading\n"), "p_name")).alias("md"))


@query(f"""SELECT id, kind, title, (o + a)::INT AS start_line, (o + z)::INT AS end_line, content FROM ({_MD}) , (VALUES ('h1', 1, 8), ('h2', 3, 6), ('h3', 5, 6), ('h2', 7, 8)) s(kind, a, z),
 LATERAL (SELECT CASE WHEN a = 1 THEN p_type WHEN a = 3 THEN 'Two' WHEN a = 5 THEN 'Three' ELSE 'Other' END AS title, array_to_string(string_split(md, chr(10))[o + a:o + z], chr(10)) AS content) WHERE md IS NOT NULL
 UNION ALL SELECT id, 'preamble', '', 1, 1, 'intro ' || p_name FROM ({_MD}) WHERE o = 1
 UNION ALL SELECT id, 'full', '', 1, 2, 'no heading' || chr(10) || p_name FROM ({_MD}) WHERE md IS NULL""")
def markdown_chunks(t):
    return chunking.markdown_chunks(_markdown(t), "id", "md").drop("level")


@query(f"""SELECT id, level::INT AS level, title, (o + a)::INT AS start_line, (o + z)::INT AS end_line, content FROM ({_MD}), (VALUES (1, 1, 2, 'a'), (2, 3, 4, 'b'), (3, 5, 5, ''), (5, 6, 6, ''), (2, 7, 8, 'c')) s(level, a, z, content),
 LATERAL (SELECT CASE a WHEN 1 THEN p_type WHEN 3 THEN 'Two' WHEN 5 THEN 'Three' WHEN 6 THEN 'Five' ELSE 'Other' END AS title) WHERE md IS NOT NULL
 UNION ALL SELECT id, 0, '', 1, 1, 'intro ' || p_name FROM ({_MD}) WHERE o = 1
 UNION ALL SELECT id, 0, '', 1, 2, 'no heading' || chr(10) || p_name FROM ({_MD}) WHERE md IS NULL""")
def markdown_flat_sections(t):
    return chunking.flat_sections(_markdown(t), "id", "md").drop("ord")


_GENERIC = "SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents"


@query(f"SELECT id, 1 AS start_line, len(x)::INT AS end_line, 'file' AS kind FROM ({_GENERIC}) WHERE len(x) <= 30 UNION ALL SELECT id, (a + 1)::INT, least(a + 30, n)::INT, 'block' FROM (SELECT id, len(x) AS n, unnest(range(0, len(x) - 5, 25)) AS a FROM ({_GENERIC}) WHERE len(x) > 30)")
def generic_chunks(t):
    return chunking.generic_chunks(t.documents, "doc_id", "text").select("id", "start_line", "end_line", "kind")


@query("SELECT event_id AS id, props AS content, 1 AS end_line FROM events WHERE event_id % 2 = 0")
def json_chunks(t):
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.substring("props", 1, 5))
    return chunking.json_chunks(t.events.select("event_id", broken.alias("props")), "event_id", "props").select("id", "content", "end_line")


@query("SELECT event_id AS id, unnest(['f.a', 'f.a.' || k[1], 'f.l', 'f.l[0]', 'f.l[1]', 'f.l[1].z']) AS path FROM (SELECT event_id, json_keys(props) AS k FROM events)")
def json_paths_deep(t):
    nested = F.concat(F.lit('{"a": '), "props", F.lit(', "l": [1, {"z": null}]}'))
    return t.events.select(F.col("event_id").alias("id"), F.explode(jp.paths(nested, F.lit("f"))).alias("path"))


# -- stored search -----------------------------------------------------------------------------------

_POSTS = f"tok AS ({TOKENS}), post AS (SELECT id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL), dl AS (SELECT d.doc_id AS id, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t ON t.id = d.doc_id), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl)"
_BATCH = f"""{_POSTS}, q AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\w{{2,}}')) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
sc AS (SELECT qid, p.id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25 FROM q JOIN post p USING (term) JOIN df USING (term) JOIN dl ON dl.id = p.id, st GROUP BY qid, p.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS r FROM sc)"""


def _stored(t):
    """The documents' postings and lengths as an index stores them."""
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    return search.postings(docs, keep=()), search.lengths(docs, keep=())


def _queries(t):
    return t.benchmark.select(F.col("item_id").cast("long").alias("qid"), F.col("text").alias("query"))


@query(f"WITH {_BATCH} SELECT qid::BIGINT AS qid, id, round(bm25, 6) AS bm25 FROM rk WHERE r <= 10")
def stored_bm25_batch(t):
    posts, sizes = _stored(t)
    return search.bm25(posts, sizes, _queries(t), 10).select("qid", "id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_BATCH} SELECT id, round(bm25, 6) AS bm25 FROM (SELECT id, max(bm25) AS bm25 FROM sc WHERE qid = 0 GROUP BY id) ORDER BY round(max(bm25) OVER (PARTITION BY id), 9) DESC, id LIMIT 20")
def candidate_files(t):
    posts, sizes = _stored(t)
    found = search.bm25(posts, sizes, _queries(t).where("qid = 0"))
    return found.groupBy("id").agg(F.max("bm25").alias("bm25")).orderBy(F.round("bm25", 9).desc(), "id").limit(20).select("id", F.round("bm25", 6).alias("bm25"))


#: Two queries of documents' words with the vectors of the same numbers.
_TWO = "(VALUES (0, 'the that thand de la the', ['the', 'that', 'thand', 'de', 'la']), (1, 'of the nd reou', ['of', 'the', 'nd', 'reou']))"


@query(f"""WITH {_POSTS}, qs(qid, query, asked) AS (SELECT * FROM {_TWO}), q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '\\w{{2,}}')) AS term FROM qs) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), idf AS (SELECT qid, term, times, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM q JOIN df USING (term), st),
sc AS (SELECT qid, p.id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25 FROM idf JOIN post p USING (term) JOIN dl ON dl.id = p.id, st GROUP BY qid, p.id),
lx AS (SELECT qid, id, 1 / (1 + exp(-bm25 / 3 + 1)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS r FROM sc) WHERE r <= 30),
cs AS (SELECT e.vec_id AS qid, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cos FROM embeddings v, embeddings e WHERE e.vec_id < 2),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, id) AS r FROM cs) WHERE r <= 30),
cd AS (SELECT qid, id FROM lx UNION SELECT qid, id FROM nr),
sal AS (SELECT * FROM (SELECT *, median(idf) OVER (PARTITION BY qid) AS mid FROM idf) WHERE idf >= mid),
x AS (SELECT cd.qid, cd.id, coalesce(b, 0) AS b, coalesce(cos, 0) AS cos, lower(text) AS low, query, asked FROM cd JOIN qs USING (qid) JOIN documents d ON d.doc_id = cd.id LEFT JOIN lx ON lx.qid = cd.qid AND lx.id = cd.id LEFT JOIN cs ON cs.qid = cd.qid AND cs.id = cd.id),
sh AS (SELECT x.qid, x.id, sum(CASE WHEN contains(low, term) OR (length(term) > 4 AND list_contains(regexp_extract_all(low, '\\w{{2,}}'), term[1:4])) THEN idf ELSE 0 END) / sum(idf) AS share FROM x JOIN sal ON sal.qid = x.qid GROUP BY x.qid, x.id),
y AS (SELECT x.*, share, len(list_filter(asked, lambda w: contains(low, w)))::DOUBLE / len(asked) AS coverage FROM x JOIN sh ON sh.qid = x.qid AND sh.id = x.id),
z AS (SELECT *, CASE WHEN contains(low, query) THEN 0.5::DOUBLE WHEN coverage >= 0.8 THEN 0.2::DOUBLE WHEN coverage >= 0.6 THEN 0.1::DOUBLE ELSE 0 END AS ph FROM y),
w AS (SELECT *, (0.62::DOUBLE * cos + 0.33::DOUBLE * b + ph + 0.1::DOUBLE * share) * greatest(0.72::DOUBLE, 1 - 0.16::DOUBLE * (1 - share)) AS score, (cos + 1) / 2 AS semantic, least(1, 0.33::DOUBLE * b + least(0.2::DOUBLE, 0.15::DOUBLE * coverage)) AS structured FROM z)
SELECT qid::BIGINT AS qid, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(structured, 9) DESC, round(semantic, 9) DESC, round(score, 9) DESC, id) AS rank FROM w WHERE score >= 0.15 OR b > 0.3 OR ph >= 0.2) WHERE rank <= 10""")
def stored_hybrid_batch(t):
    posts, sizes = _stored(t)
    asked = t.spark.createDataFrame([(0, "the that thand de la the"), (1, "of the nd reou")], "qid long, query string")
    asked = asked.join(t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector")), "qid")
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    chunks = t.documents.select(F.col("doc_id").alias("id"), "text")
    found = search.hybrid(chunks, posts, sizes, vectors, asked, 10)
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_BATCH}, gold AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT g.qid, min(r) AS first FROM (SELECT DISTINCT qid FROM gold) g LEFT JOIN (SELECT rk.qid, r FROM rk JOIN gold USING (qid, id) WHERE r <= 10) h ON h.qid = g.qid GROUP BY g.qid)
SELECT round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f""")
def golden_runner(t):
    posts, sizes = _stored(t)
    gold = incremental.containing(t.documents, t.benchmark).select(F.col("item_id").cast("long").alias("qid"), F.col("doc_id").alias("id"))
    ranked = search.bm25(posts, sizes, _queries(t), 10)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("bm25", 9).desc(), "id"))
    return incremental.golden_scores(ranked.withColumn("rank", rank), gold, 10)
