"""Shared folder, written cut points and size-checked joins of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 50_000
#: Parts into which a join key is split when its side is too large to broadcast.
SALTS = 16

#: A key with more than one in so many rows is hot, if it has at least HOT_ROWS rows.
UNEVEN, HOT_ROWS = 2000, 200

#: The bytes that separate words: blank and 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"

#: A list of at most this many ids may be broadcast to filter rows by it.
BROADCAST_IDS = 1_000_000

#: Rows of a batch that goes to a Python worker: whole texts are in it.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Whether a query's shuffle files are deleted when it ends; else they stay until the driver collects its garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Stands for a null id while rows are in Python, where a column of whole numbers has no nulls.
NO_ID = -(1 << 63)

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexivane-")
        spark.conf.set("spark.checkpoint.dir", where)
        _made.append((spark, where))
    # a folder without a scheme is where Spark puts it, also for files that Python opens
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path is not None:
        _delete(df.sparkSession, path)
        _made.remove((df.sparkSession, path))


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


_held: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks: one operator's tables and cache, so that the next operator has their memory."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


#: glibc's M_MMAP_THRESHOLD, and the bytes from which an array's memory goes back to the system as soon as the array is gone.
_MMAP_THRESHOLD, WHOLE_BYTES = -3, 1 << 18

_told: list[bool] = []


def give_back() -> None:
    """Gives the memory that this process has freed back to the system: else it stays until the worker ends, beside the next operator's."""
    if "pyarrow" in sys.modules:
        sys.modules["pyarrow"].default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def sparing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInPandas: large arrays go back to the system when they are gone, the rest that it freed when its task ends."""

    def spared(batches: Iterator) -> Iterator:
        spare()
        try:
            yield from run(batches)
        finally:
            give_back()

    return spared


def spare() -> None:
    """Once a process: without a fixed threshold glibc keeps arrays of up to 32 MB for itself."""
    if not _told:
        _told.append(True)
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, WHOLE_BYTES)


def join_small(left: DataFrame, right: DataFrame, on: list[str], rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with one row a key on the right. rows: the counted rows of right.

    Up to `limit` rows are broadcast. Beyond it the join is shuffled, but for keys with a large share of the left.
    """
    if rows <= limit:
        return left.join(F.broadcast(right), on, "left")
    return join_uneven(left, right, on, "left")


def join_uneven(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Inner or left join with one row a key on the right, where some keys may hold a large share of the left.

    A key with more than one in UNEVEN of the left's rows is hot; there are fewer than UNEVEN of these, so
    their right rows are broadcast. The other keys are shuffled. left is read three times: give it a table.
    """
    key = [key] if isinstance(key, str) else key
    counts = left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HOT_ROWS)
    counts = written(counts, "uneven")
    rows = counts.agg(F.count(F.lit(1)), F.max("_n")).first()
    if not rows[0]:
        return left.join(right, key, how)
    total = left.count()
    hot = F.broadcast(counts.where(F.col("_n") * UNEVEN > total).select(*key))
    many = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return left.join(hot, key, "left_anti").join(right, key, how).unionByName(many)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_IDS) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most limit."""
    return F.broadcast(df) if rows <= limit else df


def id_in(name: str) -> Column:
    """An id column for Python code."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_out(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.nullif(F.col(name), F.lit(NO_ID)))


def text_in(name: str) -> Column:
    """A text column for Python code: null is empty. Its batches have BATCH_ROWS rows where the session has Spark's default."""
    spark = SparkSession.active()
    if spark.conf.get(_BATCH, None) in (None, "10000"):
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class Recent(dict):
    """A cache of bounded size for worker processes: keeps at least the last `size` keys it got, at most twice as many."""

    def __init__(self, size: int):
        self.size, self.older = size, {}

    def __missing__(self, key):
        """The older value, which becomes a recent one; else None."""
        value = self.older.pop(key, None)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
