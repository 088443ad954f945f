"""Operators without SQL: embedding, lexicon, display, JSON paths, weights, projects; and search over a stored index."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.__main__ import main
from lexivane.functions import display, json_paths, lexicon
from lexivane.operators import embedding, incremental, literals, modules, search, structure
from lexivane.sources import index
from lexivane.sources.store import Store


def test_embedding_providers(spark):
    own = embedding.provider()
    assert own.name == embedding.DEFAULT and own.dimension == 384
    docs = spark.createDataFrame([(0, "red apples"), (1, "red apples and pears"), (2, "stock market news"), (3, None)], "id long, text string")
    got = {r["id"]: np.array(r["v"]) for r in docs.select("id", own.column(F.col("text")).alias("v")).collect()}
    assert all(len(v) == 384 for v in got.values()) and abs(np.linalg.norm(got[0]) - 1) < 1e-6 and not got[3].any()
    assert got[0] @ got[1] > got[0] @ got[2]
    assert np.allclose(own.vectors(["red apples"])[0], got[0])
    assert embedding.provider("hashed-768").dimension == 768 and embedding.provider().dimension == 768
    with pytest.raises(ValueError, match="unknown"):
        embedding.provider("none")
    embedding.use(None)
    assert embedding.provider().dimension == 384
    assert embedding.throughput(docs, ["hashed-384"])["hashed-384"] > 0


def test_lexicon():
    told = lexicon.expand("the auth function", weak=True, most=6)
    assert [t for t, *_ in told.terms] == ["auth", "function", "authentication", "authorization", "login", "signin"]
    assert told.terms[2][1:] == (0.9, "strong", "auth") and told.text == "auth function authentication authorization login signin"
    assert lexicon.expand("of the").terms == [] and lexicon.expand("").text == ""
    assert [t for t, *_ in lexicon.expand("x Foo", {"FOO": [("x", "strong"), ("bar", "weak")]}, least=1).terms] == ["x", "foo"]


def test_display():
    assert [display.duration(x) for x in (7, 999, 1000, 61_500)] == ["7ms", "999ms", "1.0s", "1m 1.5s"]
    now = datetime(2024, 5, 1, 12)
    assert [display.age(now - timedelta(seconds=s), now) for s in (5, 120, 7200, 172_800)] == ["just now", "2m ago", "2h ago", "2d ago"]
    assert display.age(datetime(2024, 1, 2), now) == "2024-01-02"
    row = {"path": "a.py", "start_line": 1, "end_line": 9, "name": "f", "score": 0.5, "structured": 0.25, "semantic": None, "kind": "function", "module": "Python", "exported": True, "exact": False, "content": "x" * 90 + "\n1\n2\n3"}
    text = display.results([row, row])
    assert text.startswith("Found 2 results:") and "1. a.py:1-9 (f)\n   Score: 50.0% | Structured: 25.0% | Type: function | via Python | exported\n      " + "x" * 80 + "...\n      1\n      2\n\n" in text
    assert display.results([]) == display.hybrid(None, []) == "No results found."
    exact = {"query": "f", "total_files": 12, "total_matches": 30, "files": [{"path": f"p{k}", "matches": k, "line": 3, "before": "b", "content": "f()", "after": ""} for k in range(12)]}
    shown = display.hybrid(exact, [{**row, "exact": True}])
    assert "showing 10 of 12 files, 30 total matches" in shown and "> " in shown and "raised by exact matches" in shown and shown.count("f()") == 10


def test_json_paths_of_any_depth(spark):
    deep = '{"a": ' * 60 + "1" + "}" * 60
    rows = [(0, deep), (1, '[1, {"x": [null]}]'), (2, "{no"), (3, None), (4, "5")]
    got = {r["id"]: r["p"] for r in spark.createDataFrame(rows, "id long, j string").select("id", json_paths.paths(F.col("j"), F.lit("f")).alias("p")).collect()}
    assert len(got[0]) == 60 and got[0][-1] == "f" + ".a" * 60
    assert got[1] == ["f[0]", "f[1]", "f[1].x", "f[1].x[0]"] and got[2] == got[3] == got[4] == []


def test_hill_climb_finds_the_top():
    found, value = incremental.hill_climb(lambda w: -((w["a"] - 0.31) ** 2) - (w["b"] - 0.1) ** 2, {"a": 0.2, "b": 0.2})
    assert abs(found["a"] - 0.31) < 0.02 and abs(found["b"] - 0.1) < 0.02 and value > -0.001


def test_registry():
    every = modules.registry()
    assert [m.id for m in every][0] == "core" and len(every) == 7
    assert modules.usable(modules.registry(["core", "data/json"]), ["data/json", "docs/markdown"]) == ["data/json"]


def test_literals_keep_the_best_kind(spark):
    chunks = spark.createDataFrame([("c1", "a.ts", "Foo", "class", "import { Foo, Bar as B, baz } from 'x'\nimport Def from 'y'\nclass Foo extends Bar implements Error {}"), ("c2", "b.ts", None, "file", "class A extends FOO {}\nclass B extends Foo {}")], "chunk_id string, path string, name string, type string, content string")
    got = sorted((r["chunk_id"], r["key"], r["match_type"]) for r in literals.literal_index(chunks, deep=True).collect())
    assert got == [("c1", "bar", "import"), ("c1", "def", "import"), ("c1", "foo", "definition"), ("c2", "foo", "reference")]


def test_conventions_can_be_added(spark):
    table = [*structure.CONVENTIONS, structure.Convention("page", "framework", r"(^|/)app/.*page\.tsx$", ["route"], r"app/(.+?)/page\.", unless="_generated")]
    rows = spark.createDataFrame([("web/app/users/page.tsx",), ("app/_generated/page.tsx",)], "path string")
    assert [r[0] for r in rows.select(structure.convention_keywords(F.col("path"), table)).collect()] == [["route", "users"], []]


def test_batches_of_queries_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(search, "AT_ONCE", 3)
    rng = np.random.default_rng(1)
    own = rng.normal(size=(40, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)] + [(99, [0.0] * 8)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own[:10] * 3)], "qid long, vector array<double>")
    got = search.cosine(vectors, queries, 2).collect()
    assert len(got) == 20 and {r["id"] for r in got if abs(r["cos"] - 1) < 1e-6} == set(range(10))
    assert search.cosine(vectors, queries.where("false"), 2).count() == 0


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    files = {
        "src/auth/login.ts": "export class LoginService {\n  signIn(user) { return user }\n}\n\nexport function resetPassword(mail) {\n  return mail\n}\n",
        "src/auth/token.py": "def make_token(user):\n    return user\n",
        "docs/guide.md": "# Guide\nHow to sign in.\n## Reset password\nWrite a mail.\n",
        "package.json": '{"name": "shop", "scripts": {"login": "x"}}',
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_hybrid_search_over_a_stored_index(spark, project, tmp_path):
    at = str(tmp_path / "store")
    assert index.refresh(spark, str(project), at) == {"new": 4}
    assert index.refresh(spark, str(project), at) == {"deleted": 0}
    tables = {r["table_name"] for r in Store(spark, at).status().collect()}
    assert tables == {"files", "chunks", "symbols", "core", "postings", "lengths", "literals", "vectors"}
    first = index.search(spark, at, "reset password").collect()
    assert {r["path"] for r in first[:2]} == {"src/auth/login.ts", "docs/guide.md"} and [r["rank"] for r in first] == list(range(1, len(first) + 1))
    named = index.search(spark, at, "`LoginService`").collect()
    assert (named[0]["path"], named[0]["name"], named[0]["exact"]) == ("src/auth/login.ts", "LoginService", True)
    assert {r["path"] for r in index.search(spark, at, "reset password", patterns=("*.md",)).collect()} == {"docs/guide.md"}
    assert {r["path"] for r in index.search(spark, at, "reset password", filters=("src/auth",)).collect()} <= {"src/auth/login.ts", "src/auth/token.py"}
    assert "core" in {r["module"] for r in index.search(spark, at, "make_token", core=True).collect()}
    out = main(["--store", at, "query", "reset password", "--preview", "--rank-by", "combined", "--type", "ts", "-s", "0.1"], spark)
    assert out[0].startswith("Found") and any("via TypeScript" in x for x in out)
    with pytest.raises(SystemExit):
        main(["--store", at, "query", "x", "--min-score", "3"], spark)
