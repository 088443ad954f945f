"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets its base counts in one pass without a shuffle. Failures are then
aggregated by host; a host's failure rate is shrunk towards the corpus by a beta prior whose
weight comes from the spread between hosts; hosts whose rate lies above one half even at the
lower credible limit are rejected, and the verdict is joined back to their documents.

Defined cases: a null text has no words and no lines and fails the base rules; a null host gets
no host verdict; repeated rows each count and each come back; an empty table gives an empty
result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, NOT_BLANK, join_small, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A document fails when more than this share (per cent) of its words lie in repeated windows.
MAX_REPEAT = 50
WINDOW = 3
#: A host is rejected when the lower credible limit of its failure rate is above this.
MAX_HOST_RATE = 0.5
#: Standard deviations below the posterior mean.
CREDIBLE = 1.645
#: Limits of the prior's weight in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, row (the input's columns): one row a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), F.struct("*").alias("row"))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    df = df.select(
        "doc_id",
        "host",
        "row",
        F.array_remove(F.split("text", BLANKS, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_BLANK)).alias("lines"),
        (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    w = F.col("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.select(
        "doc_id",
        "host",
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("windows"),
    )
    # each step is a column of its own: a lambda would evaluate an outer expression once an element
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    found = F.when(twice, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("found", found).drop("windows")
    found = F.col("found")
    df = df.withColumn("again", F.filter(found, lambda p, i: (p["h"] == F.get(found, i - 1)["h"]) | (p["h"] == F.get(found, i + 1)["h"]))).drop("found")
    df = df.withColumn("at", F.sort_array(F.col("again.i"))).drop("again")
    at = F.col("at")
    cover = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_counts(base: DataFrame) -> DataFrame:
    """host, n, failed: one row a host."""
    return base.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))


def host_rates(base: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk), low (lower credible limit), rejected: one row a host."""
    return rates(host_counts(base))


def rates(hosts: DataFrame) -> DataFrame:
    """host_rates() of host_counts()."""
    one = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("sq"))
    # three sums of the whole corpus: one row, whatever the input's size
    n, failed, sq = (float(x or 0) for x in one.first())
    mean = failed / n if n else 0.0
    spread = max(sq / n - mean * mean, 0.0) if n else 0.0
    weight = min(max(mean * (1 - mean) / spread - 1, PRIOR_MIN), PRIOR_MAX) if spread > 1e-12 else PRIOR_MAX
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    hosts = hosts.withColumn("rate", rate)
    low = F.col("rate") - CREDIBLE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(weight + 1)))
    return hosts.withColumn("low", low).withColumn("rejected", F.col("low") > MAX_HOST_RATE)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row a document: the base counts, base_failed, host_rate and kept."""
    base = written(base_rules(docs, id_col, text_col, host_col).drop("row"), "rules")
    hosts = written(host_rates(base).select("host", "rate", "rejected"), "hosts")
    out = join_small(base, hosts, ["host"], hosts.count(), broadcast_rows)
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
        F.round("rate", 6).alias("host_rate"),
    )


def clean(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The rules are evaluated twice, for the hosts' rates and for the rows: no copy of the texts is written, only a row a host.
    """
    base = base_rules(docs)
    counts = written(host_counts(base), "counts")
    hosts = written(rates(counts).where("rejected").select("host", F.lit(True).alias("rejected")), "hosts")
    # the number keeps the filter above the rules: pushed below them, each step would be written out in the next as often as it is named
    kept = base.withColumn("at", F.monotonically_increasing_id()).where("NOT base_failed AND at >= 0").select("host", "row")
    return join_small(kept, hosts, ["host"], hosts.count(), broadcast_rows).where("rejected IS NULL").select("row.*")


ORACLE = """
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS c
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t)
       WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(ln.c, 0)::BIGINT AS n_dup_lines, coalesce(cov.c, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS mean, greatest(sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) ** 2, 0) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, 2.0::DOUBLE), 1000.0::DOUBLE) ELSE 1000.0::DOUBLE END AS weight FROM m),
r AS (SELECT source, n, weight, (failed + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + weight + 1)) > 0.5, FALSE) AS kept,
       round(rate, 6) AS host_rate
FROM f LEFT JOIN r USING (source)
"""
