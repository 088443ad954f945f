import json
import os

import pytest
from pyspark.sql import functions as F

from lexivane.__main__ import main
from lexivane.sources import config, files, index
from lexivane.sources.store import Store
from lexivane.streaming import refresh


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "project"
    for name, text in {"src/a.py": "def alpha():\n    return 'needle'\n", "src/b.ts": "export class Beta {\n}\n", "node_modules/c.ts": "x", "d.png": "x", "e.md": "# Needle guide\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan(spark, folder):
    assert {r["path"] for r in files.scan(spark, str(folder)).collect()} == {"src/a.py", "src/b.ts", "e.md"}
    assert files.scan(spark, str(folder), extensions=None).count() == 4
    rows = files.scan(spark, str(folder), extensions=None).select(files.likely_binary(F.col("path")).alias("b")).where("b").count()
    assert rows == 1


def test_refresh_search_and_reset(spark, folder, tmp_path):
    at = str(tmp_path / "store")
    assert index.refresh(spark, str(folder), at) == {"new": 3}
    assert index.search(spark, at, "needle").count() == 2
    os.utime(folder / "src/b.ts")
    (folder / "src/a.py").write_text("def gamma():\n    pass\n")
    (folder / "e.md").unlink()
    (folder / "f.go").write_text("func Needle() {\n}\n")
    assert index.refresh(spark, str(folder), at) == {"new": 1, "changed": 1, "touched": 1, "deleted": 1}
    store = Store(spark, at)
    assert {(r["path"], r["name"]) for r in store.load("symbols").collect()} == {("src/a.py", "gamma"), ("src/b.ts", "Beta"), ("f.go", "Needle")}
    before = sorted(map(str, store.load("chunks").collect()))
    store.compact()
    assert sorted(map(str, store.load("chunks").collect())) == before
    assert main(["--store", at, "query", "needle"], spark)[0].endswith("f.go:1-2 function Needle")
    assert "files: 3 files, 3 rows" in main(["--store", at, "status"], spark)
    main(["--store", at, "reset"], spark)
    with pytest.raises(FileNotFoundError):
        store.reset()


def test_second_writer_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1)], "path string, n int")
    told = store.manifest()
    store.refresh({"t": rows}, rows)
    with pytest.raises(Exception, match="exists"):
        store._commit({**told, "number": 1})
    assert store.load("t").count() == 1


def test_stream_of_events(spark, tmp_path):
    events, store = tmp_path / "events", Store(spark, str(tmp_path / "store"))
    events.mkdir()
    put = lambda name, *rows: (events / name).write_text("\n".join(json.dumps(dict(zip(("path", "event", "ts", "content"), r))) for r in rows))
    run = lambda: refresh.follow(refresh.watch(spark, str(events)), store, index.build, str(tmp_path / "checkpoint")).awaitTermination(120)
    put("1.json", ("a.py", "add", "2024-01-01T00:00:00Z", "def one():\n    pass"), ("b.py", "add", "2024-01-01T00:00:00Z", "def two():\n    pass"), ("a.py", "change", "2024-01-01T00:00:01Z", "def three():\n    pass"))
    assert run()
    assert {r["name"] for r in store.load("symbols").collect()} == {"two", "three"}
    put("2.json", ("b.py", "unlink", "2024-01-01T00:00:02Z", None))
    assert run()
    assert {r["name"] for r in store.load("symbols").collect()} == {"three"}
    number = store.manifest()["number"]
    rows = spark.createDataFrame([("a.py",)], "path string")
    assert store.refresh({}, rows, ("stream", 0)) == number  # a batch that was applied before


def test_config(tmp_path):
    own = config.Config(extensions=["py"], min_score=2.0, ignored=["a/b"])
    config.save(own, tmp_path / "c.json")
    assert config.load(tmp_path / "c.json") == own and config.load(tmp_path / "none.json") == config.Config()
    assert {level for level, _, _ in config.issues(own)} == {"error", "warning", "info"} and not config.issues(config.Config())
    assert config.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
