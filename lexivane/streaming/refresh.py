"""File events as a stream: last event wins, upserts and deletes go to a store, statistics follow by signed deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..sources.store import Store

EVENTS = "path string, event string, ts timestamp, content string"
#: Event files of one micro-batch.
FILES_PER_BATCH = 100


def watch(spark: SparkSession, folder: str, per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Events (add, change or unlink) from JSON files that appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).json(folder)


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path; of equal times a deletion counts as the later."""
    order = F.struct("ts", (F.col("event") == "unlink").cast("int"), F.xxhash64("event", "content"))
    return events.groupBy("path").agg(F.max_by(F.struct("event", "ts", "content"), order).alias("e")).select("path", "e.*")


def follow(events: DataFrame, store: Store, build: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Applies each micro-batch to the store once: a batch that is run again after a failure changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        last = last_events(batch)
        if last.isEmpty():
            return
        files = last.where("event != 'unlink'").select("path", F.col("ts").alias("mtime"), "content", F.sha2("content", 256).alias("hash"))
        store.refresh(build(files), last, (writer, number))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """term, df, tf: what the statistics of a term gain when the rows `before` are replaced by `after` (path, content)."""

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        words = rows.select("path", F.explode(tx.tokens(F.col("content"))).alias("term")).groupBy("path", "term").agg(F.count(F.lit(1)).alias("n"))
        return words.select("term", F.lit(sign).alias("d"), (F.col("n") * sign).alias("t"))

    both = signed(before, -1).union(signed(after, 1))
    return both.groupBy("term").agg(F.sum("d").cast("long").alias("df"), F.sum("t").cast("long").alias("tf")).where("df != 0 OR tf != 0")


def apply_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """stats: term, df, tf. Terms that no document holds any more go."""
    out = stats.select("term", "df", "tf").union(deltas.select("term", "df", "tf")).groupBy("term")
    return out.agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0")


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """Events by type and sliding window; on a stream, events later than `late` are left out."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy("event_type", F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
