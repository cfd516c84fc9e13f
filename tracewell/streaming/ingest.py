"""Structured Streaming over the append-only log of turns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a turn may come. A policy of this engine: the log itself has none.
LATENESS = "10 minutes"


def turns(spark: SparkSession, path: str, schema, time: str = "event_ts", files_per_trigger: int | None = None) -> DataFrame:
    """New rows of the log's folder, each id once within the lateness allowed."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(["id"])


def sessions(rows: DataFrame, gap: str = "30 minutes", time: str = "event_ts") -> DataFrame:
    """(session_id, start, end, turns): a session ends after a gap without turns."""
    return rows.groupBy("session_id", F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("turns")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "turns")


def activity(rows: DataFrame, window: str = "5 minutes", slide: str | None = None, time: str = "event_ts") -> DataFrame:
    """Turns of each task tag by window."""
    return rows.groupBy(F.window(time, window, slide or window), "task_tag").agg(F.count(F.lit(1)).alias("turns")).select(F.col("window.start").alias("start"), "task_tag", "turns")


def pair_counts(retrievals: DataFrame) -> DataFrame:
    """(from_id, to_id, n, weight) of ordered pairs retrieved together, kept up to date over a stream of retrievals (ids, an array in order).

    For outputs in update mode; each row stands for what is known of its pair by then.
    """
    later = lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("from_id"), y.alias("to_id")))
    pairs = retrievals.select(F.explode(F.flatten(F.transform("ids", later))).alias("p")).select("p.*").filter("from_id <> to_id")
    counts = pairs.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.least(F.lit(1.0), 0.2 + 0.05 * (F.col("n") - 1)))


def access_counts(accesses: DataFrame, time: str = "event_ts") -> DataFrame:
    """(id, n, last) of every edge accessed, kept up to date over a stream of accesses (id); for outputs in update mode."""
    return accesses.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))


def dormancy(accesses: DataFrame, days: int = 30, time: str = "event_ts") -> DataFrame:
    """(id, n, last, dormant): an edge's accesses so far at each batch that has it, and once more, dormant, when none came for so many days of event time."""

    def follow(key: tuple, batches, state: GroupState):
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")], "dormant": [True]})
            return
        for batch in batches:
            n += len(batch)
            last = max(last, int(batch[time].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")], "dormant": [False]})

    kind = accesses.schema["id"].dataType.simpleString()
    rows = accesses.withWatermark(time, LATENESS).select("id", time)
    return rows.groupBy("id").applyInPandasWithState(follow, f"id {kind}, n long, last timestamp, dormant boolean", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def start(rows: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Hands each micro-batch to apply(batch, number), which has to make a batch that comes twice count once (by its number)."""
    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def append_batches(root: str) -> Callable[[DataFrame, int], None]:
    """An apply for start: each batch in a folder of its number, written again in place if it comes twice."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return apply
