import pytest
from pyspark.sql import functions as F

from lexivane.functions import scoring, text as tx
from lexivane.operators import chunking, incremental, lexical, paths


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bm25_prefers_documents_with_both_terms(spark):
    d = docs(spark, "quick brown fox", "quick red fox jumps", "brown dog", "nothing here", None, "")
    got = lexical.bm25(d, "quick brown").orderBy(F.desc("bm25")).collect()
    assert got[0]["id"] == 0 and {r["id"] for r in got} == {0, 1, 2}
    assert lexical.bm25(d, "absent").count() == 0


def test_repeated_query_terms_count_again(spark):
    d = docs(spark, "alpha beta", "beta gamma", "delta")
    one, two = (lexical.bm25(d, q).where("id = 0").first()["bm25"] for q in ("alpha", "alpha alpha"))
    assert two == pytest.approx(2 * one)


def test_cosine_of_zero_and_mismatch(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert d.select(scoring.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    bad = spark.createDataFrame([([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="different lengths"):
        bad.select(scoring.cosine(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize(("lines", "chunks"), [(0, 1), (1, 1), (50, 1), (51, 2), (90, 2), (91, 3)])
def test_line_chunks(spark, lines, chunks):
    d = docs(spark, "\n".join(f"line {i}" for i in range(lines)))
    got = chunking.line_chunks(d, "doc_id", "text", 50, 10).collect()
    assert len(got) == chunks
    assert got[0]["start_line"] == 1 and max(r["end_line"] for r in got) == max(1, lines)


def test_overlapping_occurrences(spark):
    d = docs(spark, "aaaa", "b aa\naa", None)
    assert {r["id"]: r["matches"] for r in chunking.match_counts(d, "aa", "doc_id", "text").collect()} == {0: 3, 1: 2}
    first = chunking.occurrences(d, "aa", "doc_id", "text", 2).where("id = 1").orderBy("line").collect()
    assert [(r["line"], r["column"], r["before"], r["after"]) for r in first] == [(1, 2, None, "aa"), (2, 0, "b aa", None)]
    assert chunking.occurrences(d, "", "doc_id", "text").count() == 0


def test_headings_nest(spark):
    d = docs(spark, "intro\r\n# A\r\ntext\n## B\nmore\n# C")
    got = [(r["line"], r["level"], r["title"], r["end_line"]) for r in chunking.headings(d, "doc_id", "text").orderBy("line").collect()]
    assert got == [(2, 1, "A", 5), (4, 2, "B", 5), (6, 1, "C", 6)]


def test_identifiers(spark):
    d = spark.createDataFrame([("getUserName",), ("HTTPServer_v2",), ("kebab-case",), ("MAX_SIZE",), ("plain words",), ('"quoted"',)], "q string")
    got = {r["q"]: (r["v"], r["i"]) for r in d.select("q", tx.vocabulary(F.col("q")).alias("v"), tx.is_identifier(F.col("q")).alias("i")).collect()}
    assert got["getUserName"] == (["get", "user", "name"], True)
    assert got["HTTPServer_v2"][0] == ["http", "server", "v2"]
    assert got["kebab-case"][1] and got["MAX_SIZE"][1] and got['"quoted"'][1] and not got["plain words"][1]


def test_path_filters_and_layers(spark):
    d = spark.createDataFrame([("src/services/auth/login.ts",), ("docs/guide.md",), ("docs/notes.md",), ("src/x/user.controller.ts",)], "p string")
    p = F.col("p")
    rows = {r["p"]: r for r in d.select("p", paths.layer(p).alias("layer"), paths.domain(p).alias("domain"), paths.fits_filter(p, "**/*.{ts,tsx}").alias("g"), paths.fits_filter(p, "./src/services").alias("s")).collect()}
    assert rows["src/services/auth/login.ts"]["layer"] == "service" and rows["src/services/auth/login.ts"]["domain"] == "auth"
    assert rows["src/x/user.controller.ts"]["layer"] == "controller"
    assert rows["src/services/auth/login.ts"]["g"] and rows["src/services/auth/login.ts"]["s"]
    assert not rows["docs/notes.md"]["g"] and rows["docs/notes.md"]["layer"] is None
    assert rows["docs/guide.md"]["layer"] == "presentation"  # a word within the file name is enough: ui


def test_longest_prefix(spark):
    files = spark.createDataFrame([("apps/web/a.ts",), ("apps/x.ts",), ("z.ts",)], "path string")
    roots = spark.createDataFrame([("apps", "all"), ("apps/web", "web")], "root string, name string")
    assert {tuple(r) for r in paths.longest_prefix(files, roots).collect()} == {("apps/web/a.ts", "web"), ("apps/x.ts", "all")}


def test_containing_handles_short_items(spark):
    d = docs(spark, "x one two three four five six y", "one two", "nothing")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "one two"), (3, ""), (4, None)], "item_id int, text string")
    assert {tuple(r) for r in incremental.containing(d, items).collect()} == {(1, 0), (2, 0), (2, 1)}
