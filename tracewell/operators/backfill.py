"""Vectors for what has none yet, a batch at a time, each batch committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.blocks import numbered
from tracewell.session import materialise, release
from tracewell.sources.commits import Store

#: Items that one batch takes, and the batches that try an item.
BATCH, TRIES = 100_000, 2


def backfill(store: Store, items: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, batch: int = BATCH) -> Store:
    """The store with a vector in its table vectors (id, model, vector) for each of items (id, text) that embed makes one for.

    embed gets (id, text) and returns (id, vector), null or no row where it fails. Every batch is a version of the store, with its tries in
    the table attempts (id, model), so a run that breaks off goes on where it stopped, and one that is repeated
    asks for nothing that is there or was tried TRIES times. Items with null texts are left out; of repeated ids the smallest text counts.
    """
    spark = store.spark
    if "vectors" not in store.folders:
        kind = items.schema["id"].dataType.simpleString()
        store = store.publish(replace={"vectors": spark.createDataFrame([], f"id {kind}, model string, vector array<float>"), "attempts": spark.createDataFrame([], f"id {kind}, model string")})
    rows = materialise(items.filter("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text")), "backfill-items")
    while True:
        have = store.table("vectors").filter(F.col("model") == model).select("id")
        tried = store.table("attempts").filter(F.col("model") == model).groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= TRIES).select("id")
        next_ = materialise(_first(rows.join(have, "id", "left_anti").join(tried, "id", "left_anti"), batch), "backfill-batch")
        if next_.isEmpty():
            release(next_, rows)
            return store
        made = embed(next_.select("id", "text")).filter("vector is not null").select("id", F.lit(model).alias("model"), F.col("vector").cast("array<float>").alias("vector"))
        store = store.publish(append={"vectors": made, "attempts": next_.select("id", F.lit(model).alias("model"))})
        release(next_)


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of the smallest ids, none of which comes twice. Only the id of the last is sought, in sorted ranges; a limit would bring all rows to one task."""
    ids = materialise(rows.select("id"), "backfill-ids")
    if ids.count() > n:
        last = numbered(ids, "id").filter(F.col("place") == n).select("id").first()[0]
        rows = rows.filter(F.col("id") <= F.lit(last))
    release(ids)
    return rows


def edge_vectors(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, model, vector): vectors of chunks for the first edge (smallest id) that begins with each, or else ends with it; those of no edge are left out. Of chunks with one edge the smallest id counts."""
    begins = edges.groupBy(F.col("from_id").alias("id")).agg(F.min("id").alias("_begins"))
    ends = edges.groupBy(F.col("to_id").alias("id")).agg(F.min("id").alias("_ends"))
    rows = vectors.join(begins, "id", "left").join(ends, "id", "left").withColumn("edge_id", F.coalesce("_begins", "_ends")).filter("edge_id is not null")
    return rows.groupBy("edge_id", "model").agg(F.min_by("vector", "id").alias("vector"))
