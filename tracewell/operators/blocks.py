"""Every row against a stated set of queries, whatever the size of that set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A set of at most this many rows (counted) is sent to the items whole; a larger one is dealt in blocks of about as many.
BLOCK_ROWS = 4096
#: Items that a tile holds, about.
TILE_ROWS = 100_000
#: Lengths of the beginnings by which queries are looked up in texts (the longest that a query has), and queries that are sent at once.
BEGINNINGS, NEEDLES = (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64), 500_000
#: Rows that a task of a dealt table gets, about, and that it gets at least where there are fewer than that for every core.
PART_ROWS, LEAST_ROWS = 500_000, 10_000


def parts_of(df: DataFrame, rows: int) -> int:
    """Into how many parts so many rows are dealt: more with the rows, so that what a task holds does not grow with them."""
    return max(-(-rows // PART_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), 1)


def against(items: DataFrame, queries: DataFrame, item_key: str, query_key: str, where: Column | None = None) -> DataFrame:
    """Pairs of items and queries for which where holds (null: all pairs), with the columns of both.

    The queries are counted first. A few go to every task; more are dealt by a hash of query_key into
    blocks, and items by a hash of item_key into tiles of about TILE_ROWS, and each block meets each tile in a task of its
    own, so neither side is ever whole in one place. Null keys count as one key; no pair is lost.
    """
    n = queries.count()
    if n <= BLOCK_ROWS:
        pairs = items.crossJoin(F.broadcast(queries))
        return pairs if where is None else pairs.filter(where)
    blocks, tiles = -(-n // BLOCK_ROWS), max(1, -(-items.count() // TILE_ROWS))
    part = lambda key, parts: F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = items.withColumn("_tile", part(item_key, tiles)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", part(query_key, blocks)).withColumn("_tile", every(tiles))
    pairs = left.join(right, ["_block", "_tile"]).drop("_block", "_tile")
    return pairs if where is None else pairs.filter(where)


def containing(items: DataFrame, text: str, queries: DataFrame, query: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of items and queries whose text has the query in it, whatever the case, with the columns of both; these columns have to be equal too.

    No text meets a query that it has no beginning of: a text's distinct parts of the lengths that the queries' beginnings have are looked
    up among those, and the pairs found are compared whole. Over NEEDLES queries (counted) go in several sets, each sent by itself. A null is in nothing.
    """
    from tracewell.session import materialise

    low = F.lower(F.col(query))
    size = reduce(lambda out, n: F.when(F.char_length("_q") >= n, F.lit(n)).otherwise(out), BEGINNINGS[1:], F.lit(BEGINNINGS[0]))
    asked = queries.withColumn("_q", low).filter("_q is not null").withColumn("_n", size).withColumn("_key", F.expr("substring(_q, 1, _n)"))
    asked = materialise(asked, "containing-queries")
    held = asked.groupBy("_n").count().collect()  # a row for each of BEGINNINGS at most
    sizes, sets = F.array(*[F.lit(n) for n in sorted(r["_n"] for r in held)]), max(1, -(-sum(r["count"] for r in held) // NEEDLES))
    parts = F.array_distinct(F.regexp_extract_all("_low", F.concat(F.lit("(?s)(?=(.{"), "_n", F.lit("}))")), F.lit(1)))
    rows = items.withColumn("_low", F.lower(F.col(text))).withColumn("_n", F.explode(sizes if held else F.array().cast("array<int>"))).withColumn("_key", F.explode(parts))
    of = lambda k: asked.filter(F.pmod(F.xxhash64("_q", *on), F.lit(sets)) == k) if sets > 1 else asked
    met = [rows.join(F.broadcast(of(k)), ["_n", "_key", *on]).filter(F.contains("_low", "_q")) for k in range(sets)]
    return reduce(DataFrame.unionByName, met).drop("_low", "_q", "_n", "_key")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with place, from 1, in this total order over all of them: sorted by ranges, with the counts of the ranges before added."""
    from tracewell.session import materialise

    cut = materialise(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    w = Window.partitionBy("_part").orderBy(*order)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    before = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return cut.withColumn("_row", F.row_number().over(w)).join(F.broadcast(before), "_part").withColumn("place", (F.col("_row") + F.col("_before")).cast("long")).drop("_part", "_row", "_before")


def placed(rows: DataFrame, by: str, *order: str | Column) -> DataFrame:
    """rows with place, from 1, in this total order within each group of by: sorted by ranges of both, so no task holds a group.

    Rows are counted first. A place is the row's in its range, less that of its group's first row there, and the group's counts of the
    ranges before are added.
    """
    from tracewell.operators.bm25 import sent
    from tracewell.session import materialise

    cut = rows.repartitionByRange(parts_of(rows, rows.count()), by, *order).sortWithinPartitions(by, *order)
    cut = materialise(cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "placed")
    ahead = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range that the group is in
    first = cut.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialise(first.select("_by", "_of", (F.col("_first") - F.coalesce(F.sum("_n").over(ahead), F.lit(0))).alias("_first")), "placed-first")
    met = cut.join(sent(first, first.count()), (F.col("_part") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn("place", F.col("_at") - F.col("_first") + 1).select(*rows.columns, "place")
