"""Lexical statistics, BM25 and its variants, vectors, phrases, chunks, exact track."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text as tx
from ..operators import chunking, lexical
from .registry import query

#: Query words: frequent, rarer, and repeated.
WORDS = "the that thand de la the"
TOKENS = "SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\w{2,}')) AS term FROM documents"
BM25 = f"""
tok AS ({TOKENS}),
dl AS (SELECT d.doc_id AS id, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t ON t.id = d.doc_id),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(['the', 'that', 'thand', 'de', 'la', 'the']) AS term) GROUP BY term),
p AS (SELECT id, term, count(*)::DOUBLE AS tf FROM tok SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
w AS (SELECT f.term, times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w, avgdl FROM f JOIN q USING (term), s),
b AS (SELECT p.id, sum(w * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
      FROM p JOIN w USING (term) JOIN dl USING (id) GROUP BY p.id)
"""


@query(f"WITH tok AS ({TOKENS}) SELECT id AS doc_id, count(*)::BIGINT AS n_tokens, count(DISTINCT term)::BIGINT AS n_terms FROM tok GROUP BY id")
def tokenize_counts(t):
    words = t.documents.select("doc_id", tx.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@query(f"WITH tok AS ({TOKENS}) SELECT term, count(DISTINCT id)::BIGINT AS df, count(*)::BIGINT AS tf FROM tok GROUP BY term")
def token_df(t):
    return lexical.term_df(lexical.postings(t.documents, "doc_id", "text"))


@query(f"WITH tok AS ({TOKENS}), f AS (SELECT term, count(DISTINCT id)::DOUBLE AS df FROM tok GROUP BY term) SELECT term, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM f")
def idf_terms(t):
    df = lexical.term_df(lexical.postings(t.documents, "doc_id", "text"))
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(n)).select("term", F.round(scoring.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {BM25} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM s")
def corpus_stats(t):
    return lexical.corpus_stats(lexical.lengths(t.documents, "doc_id", "text")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25} SELECT id, round(bm25, 6) AS bm25 FROM b ORDER BY b.bm25 DESC, id LIMIT 10")
def bm25_topk(t):
    return lexical.bm25(t.documents, WORDS).orderBy(F.desc("bm25"), "id").limit(10).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {BM25} SELECT id, round(1 / (1 + exp(-bm25 / 3 + 1)), 6) AS b FROM b")
def bm25_sigmoid(t):
    return lexical.bm25(t.documents, WORDS).select("id", F.round(scoring.sigmoid(F.col("bm25")), 6).alias("b"))


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, id) AS r FROM b) SELECT id, CASE WHEN r <= 30 THEN round(1 / (1 + exp(-bm25 / 3 + 1)), 6) ELSE 0.0::DOUBLE END AS b FROM r")
def bm25_capped(t):
    return lexical.capped(lexical.bm25(t.documents, WORDS), 10).select("id", F.round("b", 6).alias("b"))


@query(f"WITH {BM25.replace(TOKENS, 'SELECT DISTINCT * FROM (' + TOKENS + ')')} SELECT id, round(bm25, 6) AS bm25 FROM b")
def bm25_set_tokens(t):
    return lexical.bm25(t.documents, WORDS, distinct=True).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH documents AS (SELECT * FROM main.documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)), {BM25} SELECT id, round(bm25, 6) AS bm25 FROM b")
def bm25_after_delete(t):
    kept = t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_anti")
    return lexical.bm25(kept, WORDS).select("id", F.round("bm25", 6).alias("bm25"))


def _probe(t):
    return F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("probe")))  # one row


_V = "WITH q AS (SELECT embedding::DOUBLE[] AS probe FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], probe) AS cos, list_distance(embedding::DOUBLE[], probe) AS far FROM embeddings, q)"


@query(f"{_V} SELECT id, round(cos, 6) AS cos FROM c ORDER BY round(c.cos, 9) DESC, id LIMIT 10")
def cosine_topk(t):
    df = t.embeddings.join(_probe(t)).select(F.col("vec_id").alias("id"), scoring.cosine(F.col("embedding"), F.col("probe")).alias("cos"))
    return df.orderBy(F.round("cos", 9).desc(), "id").limit(10).select("id", F.round("cos", 6).alias("cos"))


@query(f"{_V}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cos, 9) DESC, id) AS rank FROM c) SELECT id, label, rank::INT AS rank, round(cos, 6) AS cos FROM r WHERE rank <= 3")
def cosine_per_label_topk(t):
    df = t.embeddings.join(_probe(t)).select(F.col("vec_id").alias("id"), "label", F.round(scoring.cosine(F.col("embedding"), F.col("probe")), 9).alias("cos"))
    return lexical.per_group_top(df, "label", "cos", 3).select("id", "label", "rank", F.round("cos", 6).alias("cos"))


@query(f"{_V} SELECT id, round(far, 6) AS far FROM c ORDER BY round(c.far, 9), id LIMIT 10")
def euclidean_topk(t):
    df = t.embeddings.join(_probe(t)).select(F.col("vec_id").alias("id"), scoring.euclidean(F.col("embedding"), F.col("probe")).alias("far"))
    return df.orderBy(F.round("far", 9), "id").limit(10).select("id", F.round("far", 6).alias("far"))


@query(f"{_V} SELECT id, round(least(1, greatest(0, (cos + 1) / 2)), 6) AS share FROM c")
def semantic_pct(t):
    return t.embeddings.join(_probe(t)).select(F.col("vec_id").alias("id"), F.round(scoring.semantic_share(scoring.cosine(F.col("embedding"), F.col("probe"))), 6).alias("share"))


_COV = "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ("de", "la", "that", "thand", "the")) + ")::DOUBLE / 5"


@query(f"SELECT doc_id, round({_COV}, 6) AS coverage FROM documents")
def token_coverage(t):
    return t.documents.select("doc_id", F.round(scoring.coverage(F.col("text"), ["de", "la", "that", "thand", "the"]), 6).alias("coverage"))


@query(f"SELECT doc_id, CASE WHEN contains(lower(text), 'of the') THEN 0.5::DOUBLE WHEN {_COV} >= 0.8 THEN 0.2::DOUBLE WHEN {_COV} >= 0.6 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM documents")
def phrase_match(t):
    return t.documents.select("doc_id", scoring.phrase_boost(F.col("text"), "of the", ["de", "la", "that", "thand", "the"]).alias("boost"))


@query(f"""WITH {BM25}, i AS (SELECT f.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM f, s),
m AS (SELECT * FROM i WHERE idf >= (SELECT median(idf) FROM i)), a AS (SELECT sum(idf) AS total FROM m),
g AS (SELECT doc_id AS id, sum(idf) AS got FROM documents, m WHERE contains(lower(text), term) OR (term = 'thand' AND regexp_matches(lower(text), '(^|[^0-9a-z_])than([^0-9a-z_]|$)')) GROUP BY doc_id),
c AS (SELECT d.doc_id AS id, coalesce(got, 0) / total AS coverage FROM documents d LEFT JOIN g ON g.id = d.doc_id, a)
SELECT id, round(coverage, 6) AS coverage, round(0.1::DOUBLE * coverage, 6) AS boost, round(greatest(0.72::DOUBLE, 1 - 0.16::DOUBLE * (1 - coverage)), 6) AS penalty FROM c""")
def discriminative_terms(t):
    df = lexical.discriminative(t.documents, WORDS)
    return df.select("id", *(F.round(c, 6).alias(c) for c in ("coverage", "boost", "penalty")))


def _chunks_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH l AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
    r AS (SELECT id, x, unnest(range(0, greatest(len(x) - {overlap} - 1, 0) + 1, {step})) AS a0 FROM l)
    SELECT id, (a0 // {step})::INT AS ord, (a0 + 1)::INT AS start_line, least(a0 + {size}, len(x))::INT AS end_line,
    array_to_string(x[a0 + 1:least(a0 + {size}, len(x))], chr(10)) AS content FROM r"""


@query(_chunks_sql(50, 10))
def line_chunks_core(t):
    return chunking.line_chunks(t.documents, "doc_id", "text", 50, 10)


@query(_chunks_sql(30, 5))
def line_chunks_generic(t):
    return chunking.line_chunks(t.documents, "doc_id", "text", 30, 5)


@query(f"SELECT translate(d.source || '/' || lang || '/doc_' || d.doc_id || '.md', '/.', '-_') || '-' || start_line || '-' || end_line AS chunk_id, sha256(content) AS hash FROM ({_chunks_sql(50, 10)}) c JOIN documents d ON d.doc_id = c.id")
def chunk_ids(t):
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".md"))
    paths = t.documents.select(F.col("doc_id").alias("id"), path.alias("path"))
    c = chunking.line_chunks(t.documents, "doc_id", "text", 50, 10).join(paths, "id")
    return c.select(chunking.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("chunk_id"), F.sha2("content", 256).alias("hash"))


_LIT = "then"
_OCC = f"""WITH l AS (SELECT doc_id AS id, unnest(x) AS content, unnest(range(1, len(x) + 1)) AS line, x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
o AS (SELECT id, line, x, content, unnest(list_filter(range(0, length(content)), lambda i: substr(content, i + 1, 4) = '{_LIT}')) AS col FROM l WHERE contains(content, '{_LIT}'))"""


@query(f"{_OCC}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, col) AS r FROM o) SELECT id, line::INT AS line, col::INT AS col, x[line - 1] AS before, content, x[line + 1] AS after FROM r WHERE r <= 5")
def exact_occurrences(t):
    return chunking.occurrences(t.documents, _LIT, "doc_id", "text").withColumnRenamed("column", "col")


@query(f"{_OCC} SELECT id, count(*)::BIGINT AS matches FROM o GROUP BY id")
def exact_file_counts(t):
    return chunking.match_counts(t.documents, _LIT, "doc_id", "text")


@query(f"{_OCC}, g AS (SELECT id, count(*) AS m FROM o GROUP BY id) SELECT sum(m)::BIGINT AS total_matches, count(*)::BIGINT AS total_files, count(*) > 20 AS truncated FROM g")
def exact_totals(t):
    m = chunking.match_counts(t.documents, _LIT, "doc_id", "text")
    return m.agg(F.sum("matches").alias("total_matches"), F.count(F.lit(1)).alias("total_files")).withColumn("truncated", F.col("total_files") > 20)


@query("SELECT doc_id FROM documents WHERE length(text) <= 1048576 AND NOT contains(text, chr(0)) AND source NOT IN ('src1')")
def searchable_content(t):
    return t.documents.where((F.length("text") <= 1048576) & ~F.contains("text", F.lit("\0")) & ~F.col("source").isin("src1")).select("doc_id")


@query("WITH l AS (SELECT p_partkey, '# ' || p_type || chr(10) || p_name || chr(10) || '## ' || p_brand || chr(10) || 'text' || chr(10) || '# end' AS x FROM part) SELECT p_partkey AS id, unnest([1, 3, 5]) AS line, unnest([1, 2, 1]) AS level, unnest([string_split(x, chr(10))[1][3:], string_split(x, chr(10))[3][4:], 'end']) AS title, unnest([4, 4, 5]) AS end_line FROM l")
def markdown_sections(t):
    doc = F.concat(F.lit("# "), "p_type", F.lit("\n"), "p_name", F.lit("\n## "), "p_brand", F.lit("\ntext\n# end"))
    return chunking.headings(t.part.select(F.col("p_partkey").alias("id"), doc.alias("md")), "id", "md")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
