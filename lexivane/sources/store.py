"""Index tables by generation, with a manifest that makes each refresh one step.

A refresh writes its rows to a new generation of each table and the paths it replaces or deletes
to `touched`; then it writes the next manifest, which readers take their generations from. A row
is live while no later generation touched its path. So a refresh costs what changed, a lost
executor or a refresh that broke off leaves only files that no manifest names, and of two writers
the second fails, since its manifest's number is taken. `compact` brings all live rows into one
generation.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import qualified

#: Stores of another version are built anew.
VERSION = "2"
#: With this many generations a refresh compacts the store.
MAX_GENERATIONS = 64


class Store:
    """tables: rows with a `path` column."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, qualified(spark, root)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at, fs = self._fs(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self) -> dict:
        """The last one; an empty one when there is none or when it is of another version."""
        for number in reversed(self._numbers()):
            told = json.loads(self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/{number}.json").first()[0])
            if told.get("version") == VERSION:
                return told
            return {"version": VERSION, "number": number, "tables": {}, "touched": [], "batches": {}}
        return {"version": VERSION, "number": 0, "tables": {}, "touched": [], "batches": {}}

    def _commit(self, told: dict) -> None:
        at, fs = self._fs(f"{self.root}/manifests/{told['number']}.json")
        out = fs.create(at, False)  # fails when another writer was first
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()

    def exists(self) -> bool:
        return bool(self.manifest()["tables"])

    @contextmanager
    def copied(self, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows as a table of the store for the time of a refresh: read once, so that all that is built from them fits together."""
        where = self._put("incoming", rows)
        try:
            yield self.spark.read.parquet(f"{self.root}/{where}")
        finally:
            self._drop([where])

    def refresh(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], touched: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Replaces the rows of the touched paths by those in tables, or by what a function makes of the tables written before it.

        batch: (writer, number) that is to be applied once.
        """
        told = self.manifest()
        if batch and told["batches"].get(batch[0], -1) >= batch[1]:
            return told["number"]
        new = told["number"] + 1
        told["touched"].append([new, self._put("touched", touched.select("path").distinct())])
        done: dict[str, DataFrame] = {}
        for name, made in tables.items():
            where = self._put(name, made(done) if callable(made) else made)
            done[name] = self.spark.read.parquet(f"{self.root}/{where}")
            told["tables"].setdefault(name, []).append([new, where])
        told["number"] = new
        if batch:
            told["batches"][batch[0]] = batch[1]
        self._commit(told)
        return self.compact() if len(told["touched"]) >= MAX_GENERATIONS else new

    def _put(self, name: str, df: DataFrame) -> str:
        """The folder of a new generation; its name is its writer's own, so no other writer can overwrite it."""
        where = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{where}")
        return where

    def _generations(self, listed: list) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/{where}").withColumn("gen", F.lit(n)) for n, where in listed]
        return reduce(DataFrame.unionByName, parts)

    def load(self, name: str) -> DataFrame:
        """The live rows of a table."""
        told = self.manifest()
        listed = told["tables"].get(name)
        if not listed:
            raise FileNotFoundError(f"the store has no table {name}")
        rows = self._generations(listed)
        if len(told["touched"]) == 1:
            return rows.drop("gen")
        last = self._generations(told["touched"]).groupBy("path").agg(F.max("gen").alias("gen"))
        return rows.join(last, ["path", "gen"], "left_semi").drop("gen")

    def compact(self) -> int:
        """All live rows in one generation; the older ones' files go at the next compaction, so that readers that began before can end."""
        told = self.manifest()
        if not told["tables"]:
            return told["number"]
        new = told["number"] + 1
        tables = {name: [[new, self._put(name, self.load(name))]] for name in told["tables"]}
        paths = [self.spark.read.parquet(f"{self.root}/{listed[0][1]}").select("path") for listed in tables.values()]
        touched = [[new, self._put("touched", reduce(DataFrame.union, paths).distinct())]]
        dropped = [where for _, where in [*told["touched"], *(x for listed in told["tables"].values() for x in listed)]]
        self._commit({**told, "number": new, "tables": tables, "touched": touched, "dropped": dropped})
        self._drop(told.get("dropped", []))
        return new

    def _drop(self, folders: list[str]) -> None:
        for where in folders:
            at, fs = self._fs(f"{self.root}/{where}")
            fs.delete(at, True)

    def status(self) -> DataFrame:
        """table_name, files, rows of every table."""
        out = None
        for name in sorted(self.manifest()["tables"]):
            one = self.load(name).agg(F.lit(name).alias("table_name"), F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("rows"))
            out = one if out is None else out.union(one)
        return out if out is not None else self.spark.createDataFrame([], "table_name string, files long, rows long")

    def reset(self) -> None:
        """Deletes the store; it is an error when there is none."""
        at, fs = self._fs(self.root)
        if not fs.exists(at):
            raise FileNotFoundError(f"no store at {self.root}")
        fs.delete(at, True)
