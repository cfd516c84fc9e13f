"""Greedy acceptance of ordered pairs under caps, without walking through them one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import materialise, release

#: The best pairs that are tried first, as a multiple of those that can be taken; all pairs if they give too few.
FIRST = 8
#: Parts into which the pairs of an end are dealt before its best are chosen.
SALTS = 64


def _leaders(ends: DataFrame, per_end: int) -> DataFrame:
    """The per_end first pairs of each end: rows (end, key, taken). An end with many pairs has them dealt over tasks first."""
    near = Window.partitionBy("end", "_salt").orderBy("key")
    some = ends.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= per_end)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("end").orderBy("key"))).filter(F.col("_n") <= per_end).select("end", "key", "taken")


def _settled(pairs: DataFrame, per_end: int) -> DataFrame:
    """The taken of pairs (key, a, b).

    A pair among the first per_end that are left at both its ends is taken whatever becomes of those before it. An end
    that has per_end taken ones has them first, so all its other pairs go. The first open pair is settled in each
    round, and with it mostly a large share of all.
    """
    now = materialise(pairs.withColumn("taken", F.lit(False)), "greedy")
    while True:
        sides = now.select("key", "taken", F.explode(F.array(F.struct(F.col("a").alias("end"), F.lit(0).alias("side")), F.struct(F.col("b").alias("end"), F.lit(1).alias("side")))).alias("e")).select("key", "taken", "e.end", "e.side")
        first = materialise(_leaders(sides.select("end", "key", "taken"), per_end), "greedy-first")
        both = first.groupBy("key").agg(F.count(F.lit(1)).alias("_at")).filter("_at = 2").select("key", F.lit(True).alias("_in"))
        marked = materialise(now.join(both, "key", "left").withColumn("taken", F.coalesce("_in", F.lit(False))).drop("_in"), "greedy-marked")
        full = first.join(marked.filter("taken").select("key"), "key", "left_semi").groupBy("end").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= per_end).select("end")
        open_ = marked.filter("not taken").join(full.select(F.col("end").alias("a")), "a", "left_anti").join(full.select(F.col("end").alias("b")), "b", "left_anti")
        before, now = now, materialise(marked.filter("taken").unionByName(open_.select(*marked.columns)), "greedy")
        release(before, first, marked)
        if now.filter("not taken").isEmpty():
            return now.drop("taken")


def accept(pairs: DataFrame, most: int, per_end: int) -> DataFrame:
    """The pairs (a, b, similarity) that a greedy pass takes: the most similar first (then smaller a, then b), per_end at an end, most in all.

    a and b are of one type and not equal; a pair that occurs twice counts once. What becomes of a pair depends on those before it alone. So
    the FIRST * most best are settled, and all of them where these give fewer than most.
    """
    key = F.struct((-F.col("similarity")).alias("order"), "a", "b")
    rows = materialise(pairs.select("a", "b", "similarity").distinct().select(key.alias("key"), "a", "b"), "greedy-pairs")
    best = materialise(rows.orderBy("key").limit(FIRST * most), "greedy-best")
    taken = _settled(best, per_end)
    if taken.count() < most and rows.count() > FIRST * most:
        release(taken)
        taken = _settled(rows, per_end)
    return taken.orderBy("key").limit(most).select("a", "b", (-F.col("key.order")).alias("similarity"))
