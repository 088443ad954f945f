"""Index of a folder: files, chunks, symbols, postings, literals and vectors in a store, refreshed by what changed; hybrid search over it."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, query_literals, scoring, text as tx
from ..operators import chunking, code, embedding, incremental, introspection, lexical, literals, modules, paths, ranking, search as stored, structure
from .files import scan, searchable
from .store import Store

#: Seconds for which a fresh index isn't looked at again.
FRESH_S = 5.0
#: Files with a quoted literal whose results are raised.
EXACT_FILES = 20
_seen: dict[str, float] = {}


def chunked(files: DataFrame) -> DataFrame:
    """path, chunk_id, module, kind, name, level, start_line, end_line, exported, doc, content: by the module that takes a file."""
    own = files.withColumn("module", F.coalesce(modules.module_of(F.col("path")), F.lit("core")))
    columns = ["path", "kind", "name", "level", "start_line", "end_line", "exported", "doc", "content"]
    bare = {"name": F.lit(None).cast("string"), "level": F.lit(0), "exported": F.lit(False), "doc": F.lit(None).cast("string")}
    md = chunking.markdown_chunks(own.where("module = 'docs/markdown'"), "path", "content").withColumnRenamed("id", "path")
    md = md.withColumns({"name": F.nullif("title", F.lit("")), "exported": bare["exported"], "doc": bare["doc"]})
    js = chunking.json_chunks(own.where("module = 'data/json'"), "path", "content").withColumnRenamed("id", "path").withColumns(bare)
    other = own.where("module NOT IN ('docs/markdown', 'data/json')").withColumn("lang", introspection.language(F.col("path")))
    other = code.chunks(other, "path", "content", "lang").withColumnRenamed("id", "path").withColumn("level", F.lit(0))
    long = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("start_line", "end_line")}).select(columns)
    every = long(md).unionByName(long(js)).unionByName(long(other))
    module = F.coalesce(modules.module_of(F.col("path")), F.lit("core"))
    return every.withColumns({"module": module, "chunk_id": F.concat_ws(":", "path", "kind", "start_line", "end_line")})


def core_terms(files: DataFrame) -> DataFrame:
    """path, term: distinct tokens of the text, words of symbols and of the file's place."""
    symbols = code.symbols(files, "path", "content").groupBy("id").agg(F.collect_set(F.lower("name")).alias("names")).withColumnRenamed("id", "path")
    place = structure.introspection_keywords(F.col("path"), F.lit("root"))
    rows = files.join(symbols, "path", "left").select("path", F.concat(tx.tokens(F.coalesce("content", F.lit(""))), F.coalesce("names", F.array().cast("array<string>")), place).alias("w"))
    return rows.select("path", F.explode(F.array_distinct("w")).alias("term"))


def build(files: DataFrame, provider: embedding.Provider | None = None) -> dict:
    """files: path, mtime, content, hash. Tables, or functions of the tables written before them."""
    provider = provider or embedding.provider()
    kept = files.where(searchable(F.col("path"), F.col("content")))
    symbols = code.symbols(kept, "path", "content").withColumnRenamed("id", "path")
    told = files.select("path", "mtime", "hash", introspection.language(F.col("path")).alias("language"), introspection.layer(F.col("path")).alias("layer"), introspection.domain(F.col("path")).alias("domain"), modules.module_of(F.col("path")).alias("module"), structure.introspection_keywords(F.col("path"), F.lit("root")).alias("words"))
    keep = ("path", "module")
    text = lambda w: w["chunks"].withColumn("text", F.concat_ws("\n", "name", "content"))
    return {
        "files": told,
        "chunks": chunked(kept),
        "symbols": symbols,
        "core": core_terms(kept),
        "postings": lambda w: stored.postings(text(w), keep=keep),
        "lengths": lambda w: stored.lengths(text(w), keep=keep),
        "literals": lambda w: literals.literal_index(w["chunks"].select("chunk_id", "path", "name", F.col("kind").alias("type"))),
        "vectors": lambda w: w["chunks"].select("path", F.col("chunk_id").alias("id"), provider.column(structure.embedding_text(F.col("path"), F.col("content"), F.col("name"), F.col("doc"))).alias("embedding")),
    }


def refresh(spark: SparkSession, root: str, at: str) -> dict[str, int]:
    """Brings the store at `at` up to the folder; counts of new, changed, touched and deleted files.

    Files are listed without their content; what has another time than the index knows is read and hashed once, into the store,
    and the index is built from that copy.
    """
    store = Store(spark, at)
    listed = scan(spark, root).select("path", "mtime")
    if not store.exists():
        with store.copied(scan(spark, root).withColumn("hash", F.sha2("content", 256))) as rows:
            store.refresh(build(rows), rows)
        return {"new": store.load("files").count()}
    old = store.load("files").select("path", "hash", "mtime")
    gone = incremental.stale(listed, old)
    suspects = listed.join(old.select("path", F.col("mtime").alias("_known")), "path", "left").where("_known IS NULL OR _known != mtime").select("path", "mtime")
    n, since = suspects.agg(F.count(F.lit(1)), F.min("mtime")).first()  # one row
    counts = {"deleted": gone.count()}
    if n:
        now = scan(spark, root, since=since - timedelta(seconds=1)).where("changed").join(suspects.select("path"), "path", "left_semi")
        with store.copied(now.withColumn("hash", F.sha2("content", 256))) as rows:
            status = incremental.changes(rows.select("path", "hash"), old.select("path", "hash"))
            counts |= {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
            store.refresh(build(rows), rows.select("path").union(gone))
    elif counts["deleted"]:
        store.refresh({}, gone)
    return counts


def ensure_fresh(spark: SparkSession, root: str, at: str) -> bool:
    """Refreshes unless that was done less than FRESH_S ago; whether it did."""
    key = f"{root}\0{at}"
    if time.monotonic() - _seen.get(key, -FRESH_S) < FRESH_S:
        return False
    refresh(spark, root, at)
    _seen[key] = time.monotonic()
    return True


def _lexical(posts: DataFrame, sizes: DataFrame, words: list[str], group: str, k: int, mid: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """b of the best k ids of each group, and its terms' idf: group, id, b; group, term, idf. Statistics are each group's own."""
    times = {w: words.count(w) for w in words}
    hits = posts.where(F.col("term").isin(list(times)))  # a filter that the order of the postings answers
    df = hits.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    one = sizes.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = df.join(F.broadcast(one), group).select(group, "term", "avgdl", scoring.idf(F.col("n"), F.col("df")).alias("idf"))  # a row a module and query term
    often = F.element_at(F.create_map(*(F.lit(x) for kv in times.items() for x in kv)), F.col("term")) if times else F.lit(1)
    part = scoring.bm25_term(F.col("idf") * often, F.col("tf"), F.col("dl"), F.col("avgdl"))
    rows = hits.join(F.broadcast(idf), [group, "term"]).groupBy(group, "id").agg(F.sum(part).alias("bm25")).where("bm25 > 0")
    best = Window.partitionBy(group).orderBy(F.desc("bm25"), "id")
    rows = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    return rows.select(group, "id", scoring.sigmoid(F.col("bm25"), mid).alias("b")), idf


def search(spark: SparkSession, at: str, query: str, k: int = 10, rank_by: str = "structured", min_score: float = 0.15, patterns: tuple[str, ...] = (), filters: tuple[str, ...] = (), core: bool = False, words: dict = lexicon.BASIC, provider: embedding.Provider | None = None) -> DataFrame:
    """The best k results of all modules: path, kind, name, start_line, end_line, module, exported, exact, score, structured, semantic, content, rank.

    patterns hold before scores are made, filters after each module's best k, as statistics depend on them. With core, the
    core's results come too, and a file may appear twice. A quoted or identifier query raises the files that hold it.
    """
    store = Store(spark, at)

    def load(name: str) -> DataFrame:
        df = store.load(name)
        return df.where(paths.fits_pattern(F.col("path"), list(patterns))) if patterns else df

    provider = provider or embedding.provider()
    quoted, rest = query_literals.parse(query)
    tokens = lexical._tokens(query)
    vector = provider.vectors([lexicon.expand(rest or query, words).text])[0]
    chunks = load("chunks")
    best, idf = _lexical(load("postings"), load("lengths"), tokens, "module", stored.CANDIDATES * k)
    index = load("literals")
    vocabulary = literals.query_vocabulary(query)
    rows = chunks.withColumn("id", F.col("chunk_id")).join(best.drop("module"), "id", "left")
    rows = rows.join(load("vectors").select("id", scoring.cosine(F.col("embedding"), F.array(*map(F.lit, vector))).alias("cos")), "id", "left")
    rows = rows.join(literals.vocabulary_scores(index, vocabulary), "chunk_id", "left")
    if quoted:
        wanted = spark.createDataFrame([(x.value, x.confidence) for x in quoted], "value string, confidence string")
        rows = rows.join(literals.contributions(literals.matches(index, wanted)).select("chunk_id", "multiplier"), "chunk_id", "left")
    else:
        rows = rows.withColumn("multiplier", F.lit(1.0))
    # rare terms, module by module
    mid = Window.partitionBy("module")
    salient = idf.withColumn("mid", F.median("idf").over(mid)).where("idf >= mid").groupBy("module").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("w"), F.sum("idf").alias("whole"))
    low, own = F.lower(F.concat_ws("\n", "name", "content")), tx.tokens(F.concat_ws("\n", "name", "content"))
    asked = sorted(set(tokens))
    near = F.array_compact(F.array(*[F.when(lexical.term_hit(t, low, own), F.lit(t)) for t in asked] or [F.lit(None).cast("string")]))
    rows = rows.join(F.broadcast(salient), "module", "left")  # a row a module
    got = F.aggregate(near, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at("w", t), F.lit(0.0)))
    share = F.coalesce(got / F.col("whole"), F.lit(1.0))
    content_words = [w for w in asked if w not in tx.STOP_WORDS]
    rows = rows.withColumns({"share": share, "phrase": scoring.phrase_boost(F.col("content"), query.lower().strip(), content_words), "coverage": scoring.coverage(F.col("content"), content_words), "nb": F.lit(0.0), "symbol": F.lit(0.0)})
    rows = rows.withColumns({"boost": F.when(F.col("whole").isNotNull(), 0.1 * F.col("share")).otherwise(0.0), "penalty": F.greatest(F.lit(0.72), 1 - 0.16 * (1 - F.col("share")))}).drop("w", "whole")
    rows = rows.fillna({"b": 0.0, "cos": 0.0, "vocab": 0.0, "multiplier": 1.0}).where("module != 'core'")
    found = modules.scored(rows, query, min_score)
    if core:
        found = found.unionByName(_core(load, chunks, query, tokens, k), allowMissingColumns=True)
    top = modules.top_per_module(found, 2 * k if core else k)
    for wanted in filters:
        top = top.where(paths.fits_filter(F.col("path"), wanted))
    literal = next((x.value for x in quoted if x.method != "implicit-casing"), quoted[0].value if quoted else None)
    if literal:
        exact = exact_files(chunks, literal).select("path").withColumn("exact", F.lit(True))
        top = top.join(F.broadcast(exact), "path", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))  # at most EXACT_FILES rows
        up = F.when(F.col("exact"), 1.5).otherwise(1.0)
        top = top.withColumns({"score": F.col("score") * up, "structured": scoring.clamp(F.col("structured") * up)})
    else:
        top = top.withColumn("exact", F.lit(False))
    shown = ["path", "kind", "name", "start_line", "end_line", "module", "exported", "exact", "score", "structured", "semantic", "content"]
    order = [F.round(c, 9).desc() for c in ranking.ORDERS[rank_by]]
    first = top.orderBy(*order, "module", "chunk_id").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order, "module", "chunk_id"))).select(*shown, "rank").orderBy("rank")  # over k rows


def _core(load, chunks: DataFrame, query: str, tokens: list[str], k: int) -> DataFrame:
    """The core's results: files by distinct terms and symbol names, each with its best chunk."""
    terms = load("core").withColumns({"id": F.col("path"), "all": F.lit(1)})
    sizes = terms.groupBy("path", "all").agg(F.count(F.lit(1)).alias("dl"))
    posts = terms.withColumn("tf", F.lit(1)).join(sizes, ["path", "all"])
    nb, _ = _lexical(posts, sizes, tokens, "all", 4 * k, 5.0)
    symbol = modules.symbol_scores(load("symbols"), tokens)
    both = nb.select(F.col("id").alias("path"), F.col("b").alias("nb")).join(symbol, "path", "full").fillna({"nb": 0.0, "symbol": 0.0})
    lines = chunks.join(both, "path").withColumn("ord", F.struct("start_line", "chunk_id"))
    own = modules.best_chunks(lines, tokens).drop("ord", "chunk_score").withColumn("module", F.lit("core"))
    for c, v in {"b": 0.0, "cos": 0.0, "vocab": 0.0, "multiplier": 1.0, "phrase": 0.0, "coverage": 0.0, "boost": 0.0, "penalty": 1.0}.items():
        own = own.withColumn(c, F.lit(v))
    return modules.scored(own, query)


def exact_files(chunks: DataFrame, literal: str, most: int = EXACT_FILES) -> DataFrame:
    """path, matches: the first files in order of their paths that hold a literal, in this case; a file's largest chunk counts."""
    found = chunking.match_counts(chunks, literal, "chunk_id", "content").withColumnRenamed("id", "chunk_id")
    files = found.join(chunks.select("chunk_id", "path"), "chunk_id").groupBy("path").agg(F.max("matches").alias("matches"))
    return files.orderBy("path").limit(most)
