"""URL filters in DataFrame functions only: longest matching rule, else a path-template tree.

Tree, per host: path segments are typed first (numbers, hex strings, strings with digits).
Then, depth by depth, a segment with many different values under one prefix becomes a wildcard,
and children whose labelled rate does not differ from that of all children of the prefix (a test
of proportions) are merged into one branch; a path that is alone under its prefix is finished. A template is rejected when its share of labels that
are bad, smoothed towards the corpus's share, is above MAX_BAD. Urls shrink to distinct typed
paths before anything is joined, so a host with a third of all rows is a few rows here.

Defined cases: rules of equal length can't both fit unless they are equal, then the later in order of their text holds; very long paths are cut
into all their segments; a null id and columns of any names come through; a null url or one without "://" has empty host and path, fits no rule and gets the
verdict of the template of that empty path; repeated rows each come back; without labels nothing
is rejected by a template; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_small, written

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A prefix with more different next segments than this, and more than MANY_SHARE of its urls, has a variable there.
MANY, MANY_SHARE = 8, 0.2
#: Children within this many standard errors of their prefix's labelled rate are merged.
SIMILAR = 1.96
#: Weight of the corpus's bad share in labels, and the smoothed bad share above which a template is rejected.
PRIOR, MAX_BAD = 10.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without '://'."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (its text) and its verdict; nulls without one. A few rules: a fixed list in the plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def typed_path(path: Column) -> Column:
    """The path's segments, typed."""
    segments = F.array_remove(F.split(path, "/", -1), "")
    return F.transform(
        segments,
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), "{n}").when(s.rlike("^[0-9a-fA-F-]{8,}$"), "{h}").when(s.rlike("[0-9]"), "{a}").otherwise(s),
    )


def templates(leaves: DataFrame) -> DataFrame:
    """leaves: host, typed, n, labelled, bad. Returns host, typed, template."""
    tree = leaves.withColumn("t", F.col("typed")).withColumn("more", F.size("typed") > 0)
    done, d = [tree.where("NOT more")], 0
    tree = tree.where("more")
    while tree.limit(1).count():  # a level at a time, until no path has a further segment
        d += 1
        tree = tree.withColumn("prefix", F.concat_ws("/", F.slice("t", 1, d - 1))).withColumn("seg", F.get("t", F.lit(d - 1)))
        child = tree.groupBy("host", "prefix", "seg").agg(F.count(F.lit(1)).alias("leaves"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        over = child.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("kinds"), *(F.sum(c).alias(f"all_{c}") for c in ("leaves", "n", "labelled", "bad")))
        over = written(over, "prefixes")
        child = join_small(written(child, "children"), over, ["host", "prefix"], over.count())  # a host's prefix may have very many children
        rate = F.when(F.col("all_labelled") > 0, F.col("all_bad") / F.col("all_labelled")).otherwise(0.0)
        error = F.sqrt(rate * (1 - rate) / F.col("labelled"))
        similar = (F.col("labelled") == 0) | (F.abs(F.col("bad") / F.col("labelled") - rate) <= SIMILAR * error)
        variable = (F.col("kinds") > MANY) & (F.col("kinds") > MANY_SHARE * F.col("all_n"))
        child = child.select("host", "prefix", "seg", ((F.col("kinds") > 1) & (variable | similar)).alias("merge"), (F.col("all_leaves") > 1).alias("shared"))
        tree = tree.join(child, ["host", "prefix", "seg"], "left")  # both have few rows a key: the leaves are distinct
        put = F.concat(F.slice("t", 1, d - 1), F.array(F.lit("*")), F.slice("t", F.lit(d + 1), F.size("t")))
        tree = tree.withColumn("t", F.when(F.col("merge"), put).otherwise(F.col("t"))).withColumn("more", F.col("shared") & (F.size("typed") > d))
        tree = written(tree.drop("merge", "shared", "prefix", "seg"), "level")
        done.append(tree.where("NOT more"))
        tree = tree.where("more")
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("host", "typed", "n", "labelled", "bad", F.concat(F.lit("/"), F.concat_ws("/", "t")).alias("template"))


def url_filter(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share: one row a page.

    labels: url_key (long), bad (0 or 1). A page is labelled by the number that ends its path.
    Several labels of one key count as their mean, rounded up.
    """
    host, path = split_url(F.col(url_col))
    df = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    df = df.withColumn("typed", typed_path(F.col("path")))
    key = F.try_to_number(F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1), F.lit("9" * 18)).cast("long")
    marks = labels.select(F.col("url_key").alias("key"), "bad").where("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max("bad").alias("bad"))
    marked = df.select("host", "typed", key.alias("key")).groupBy("host", "typed", "key").agg(F.count(F.lit(1)).alias("n")).join(marks, "key", "left")
    leaves = marked.groupBy("host", "typed").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("n"))), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum(F.when(F.col("bad") > 0, F.col("n"))), F.lit(0)).alias("bad"),
    )
    leaves = written(leaves, "leaves")
    tree = written(templates(leaves), "tree")
    # two sums of the whole corpus: one row
    labelled, bad = (float(x or 0) for x in leaves.agg(F.sum("labelled"), F.sum("bad")).first())
    share = bad / labelled if labelled else 0.0
    whole = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    whole = whole.select("host", "template", F.round((F.col("b") + F.lit(PRIOR * share)) / (F.col("l") + PRIOR), 6).alias("bad_share"))
    whole = written(whole, "templates")
    judged = written(join_small(tree.select("host", "typed", "template"), whole, ["host", "template"], whole.count(), broadcast_rows), "judged")
    out = join_small(df, judged, ["host", "typed"], judged.count(), broadcast_rows)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") > MAX_BAD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "bad_share")
