"""Change detection, expansion, sessions, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRADES = {"strong": 0.9, "moderate": 0.6, "weak": 0.3}


def changes(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, status: new, changed, or touched (same content)."""
    old = manifest.select("path", F.col("hash").alias("_old"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("hash"), "touched").otherwise("changed")
    return now.join(old, "path", "left").select("path", status.alias("status"))


def stale(now: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.select("path").join(now.select("path"), "path", "left_anti")


def expand(words: DataFrame, lexicon: DataFrame, most: int, weak: bool = False) -> DataFrame:
    """term, weight: the words, then synonyms in the lexicon's order, `most` in all. A query's words are few."""
    from itertools import chain

    grade = F.element_at(F.create_map(*map(F.lit, chain(*GRADES.items()))), F.col("grade"))
    syn = words.join(F.broadcast(lexicon), "term")
    syn = syn if weak else syn.where("grade != 'weak'")
    every = words.select("term", F.lit(1.0).alias("weight"), F.col("pos").alias("o"), F.lit(-1).alias("p")).union(syn.select("synonym", grade, F.col("pos") + 100, "ord"))
    return every.orderBy("o", "p").limit(most).select("term", "weight")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Batches of a user's events that a gap closes; works on streams as on tables."""
    df = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return df.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def containing(docs: DataFrame, items: DataFrame, width: int = 4) -> DataFrame:
    """item_id, doc_id: documents that hold an item's text.

    An equi-join on the item's first inner words (its first and last may be parts of longer
    words there), and a check of the whole text; only items of fewer than three words, which have no inner
    word, meet every document.
    """
    split = lambda c: F.array_remove(F.split(c, r"\s+", -1), "")
    words = items.where("text != ''").select("item_id", F.col("text").alias("item"), split(F.col("text")).alias("w"))
    inner = words.where(F.size("w") > 2).select("item_id", "item", F.slice("w", 2, F.least(F.size("w") - 2, F.lit(width))).alias("w"))
    keys = inner.select("item_id", "item", F.size("w").alias("n"), F.xxhash64("w").alias("key"))
    own = docs.select("doc_id", split(F.col("text")).alias("w"))
    own = own.select("doc_id", "w", F.explode(F.array(*(F.lit(n) for n in range(1, width + 1)))).alias("n")).join(F.broadcast(keys.select("n").distinct()), "n")
    own = own.where(F.size("w") >= F.col("n"))
    own = own.select("doc_id", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("n")))))).alias("key"))
    hits = own.join(keys, ["n", "key"]).select("doc_id", "item_id", "item").distinct()
    found = hits.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("item_id", "doc_id")
    short = words.where(F.size("w") <= 2).select("item_id", "item")
    return found.union(docs.join(F.broadcast(short), F.contains("text", F.col("item"))).select("item_id", "doc_id"))


def retrieval_metrics(found: DataFrame, k: int) -> DataFrame:
    """found: item_id, rank, relevant. top1 and recall: one row."""
    first = found.groupBy("item_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return first.agg(share(F.col("first") == 1).alias("top1"), share(F.col("first") <= k).alias("recall"))


def sweep(features: DataFrame, weights: list[float], k: int) -> DataFrame:
    """The best k ids under each blend of cosine and BM25: features are computed once."""
    df = features.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    score = F.round(F.col("w") * F.col("cos") + (1 - F.col("w")) * F.col("b"), 9)
    r = F.row_number().over(Window.partitionBy("w").orderBy(score.desc(), "id"))
    return df.withColumn("r", r).where(F.col("r") <= k).select("w", "id")


def golden_scores(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """ranked: qid, id, rank; gold: qid, id of what should be found. top1 and recall among the first k, over the queries with gold: one row."""
    hits = ranked.where(F.col("rank") <= k).join(gold, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    first = gold.select("qid").distinct().join(hits, "qid", "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return first.agg(share(F.col("first") == 1).alias("top1"), share(F.col("first") <= k).alias("recall"))


def hill_climb(score, start: dict[str, float], step: float = 0.02, least: float = 0.005, most: int = 200) -> tuple[dict[str, float], float]:
    """score: from weights to a figure of merit, computed on a cached table of features. Takes the first better neighbour, one weight up or down by the
    step; without one the step is halved, until it is below least. The weights, and their figure."""
    best, value, tries = dict(start), score(start), 0
    while step >= least and tries < most:
        for name, sign in [(n, s) for n in sorted(best) for s in (1, -1)]:
            near = {**best, name: round(max(0.0, best[name] + sign * step), 9)}
            tries += 1
            if near != best and (found := score(near)) > value:
                best, value = near, found
                break
        else:
            step /= 2
    return best, value
