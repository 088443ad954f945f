from pyspark.sql import functions as F

from lexivane.functions import keywords, query_literals
from lexivane.operators import code, introspection


def test_query_literals():
    found, rest = query_literals.parse('find `getUser` and "auth" in AuthService, MAX_TRIES or user-id or the a_b getuser')
    assert [(x.value, x.method, x.kind) for x in found] == [
        ("getUser", "explicit-backtick", "functionName"),
        ("auth", "explicit-quote", None),
        ("AuthService", "implicit-casing", "className"),
        ("MAX_TRIES", "implicit-casing", "variableName"),
        ("a_b", "implicit-casing", "identifier"),
        ("user-id", "implicit-casing", "packageName"),
    ]
    assert "getUser" not in rest and "AuthService" in rest
    assert query_literals.parse(None) == ([], "") and query_literals.parse('a "" b')[0] == []
    assert query_literals.parse("https://a-b.org/c-d")[0] == []


def test_typescript_chunks():
    text = '/** doc */\nexport async function run(a: string) {\n  const s = "}";\n  return `{${a}`;\n}\nconst add = (a, b) =>\n  a + b;\nexport const LIMIT = 5;\ninterface I {\n  x: number;\n}\nexport enum E { A }\n'
    got = [(k, n, a, b, e) for k, n, a, b, e, *_ in code.parse(text, "typescript")]
    assert got == [("function", "run", 2, 5, True), ("function", "add", 6, 7, False), ("variable", "LIMIT", 8, 8, True), ("interface", "I", 9, 11, False), ("enum", "E", 12, 12, True)]
    assert code.parse(text, "typescript")[0][5] == "/** doc */"


def test_python_go_rust_chunks():
    py = code.parse('import os\n\ndef f(\n  a,\n):\n    """Does f."""\n    return a\n\nclass _K:\n    def g(self):\n        pass\n', "python")
    assert [(k, n, a, b, e, d) for k, n, a, b, e, d, _ in py] == [("function", "f", 3, 7, True, "Does f."), ("class", "_K", 9, 11, False, None)]
    go = code.parse("package a\n// Run runs.\nfunc (s *S) Run() {\n}\ntype small struct {\n\tx int\n}\n", "go")
    assert [(k, n, e, d) for k, n, _, _, e, d, _ in go] == [("function", "Run", True, "// Run runs."), ("class", "small", False, None)]
    rs = code.parse("/// Doc\npub fn f() -> i32 {\n    1\n}\nstruct S;\ntrait T {}\n", "rust")
    assert [(k, n, a, b, e) for k, n, a, b, e, *_ in rs] == [("function", "f", 2, 4, True), ("class", "S", 5, 5, False), ("interface", "T", 6, 6, False)]


def test_chunks_of_other_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "typescript"), (2, "x", None), (3, None, "go")], "id long, text string, lang string")
    got = [(r["id"], r["kind"], r["end_line"]) for r in code.chunks(df, "id", "text", "lang").orderBy("id").collect()]
    assert got == [(1, "file", 1), (2, "file", 1)]


def test_symbols_keep_the_first_pattern(spark):
    df = spark.createDataFrame([(1, "function a() {}\nexport function a() {}\n  def inner():\ndef b(x):\nclass C:\nfunc (r *R) D() {\npub struct S {")], "id long, text string")
    got = {(r["name"], r["kind"], r["line"], r["exported"]) for r in code.symbols(df, "id", "text").collect()}
    assert got == {("a", "function", 2, True), ("b", "function", 4, False), ("C", "class", 5, False), ("D", "function", 6, False), ("S", "type", 7, False)}


def test_json_and_markdown_keywords(spark):
    df = spark.createDataFrame([('{"userName": "Big-Dog", "a": [{"b": "x y zed"}]}', "# Big Head\n**bold word** `codeBit` [link text](u)"), ("{bad", ""), (None, None)], "j string, m string")
    rows = df.select(keywords.json_words(F.col("j")).alias("j"), keywords.markdown(F.col("m")).alias("m")).collect()
    assert set(rows[0]["j"]) == {"username", "user", "name", "a", "b", "big", "dog", "zed"}
    assert rows[0]["m"] == ["big", "head", "bold", "word", "codebit", "link", "text"]
    assert rows[1]["j"] == [] and rows[1]["m"] == [] and rows[2]["j"] == []


def test_framework_and_scope(spark):
    df = spark.createDataFrame([("apps/x/page.tsx", "import a from 'next/link'", "zz"), ("f", "require(\"koa\")", "shop-api")], "path string, content string, project string")
    got = df.select(introspection.framework(F.col("content")), introspection.scope(F.col("path"), F.col("project")), introspection.language(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("nextjs", "unknown", "typescript"), ("koa", "backend", None)]
