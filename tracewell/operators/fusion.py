"""Rank fusion, quotas and budgets over ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx

#: Fixed value: what reciprocal rank fusion adds to ranks.
RRF_K = 60
#: Tokens that a line of each level of detail costs.
LEVEL_COST = {"L0": 25, "L1": 60, "L2": 100}


def rrf(lists: list[DataFrame], limit: int | None = None, k: int = RRF_K, parts: int | None = None) -> DataFrame:
    """(qid, id, score, rank) from lists (qid, id, rank from 1): sum of 1 / (k + rank). Ties: the first list that has it, then its rank there, then id.

    Rows meet by qid and id, never by qid alone; parts: into how many tasks long lists are dealt for that. Ranks are under 2^40.
    """
    first = lambda i: F.lit(i << 40).cast("long") + F.col("rank")
    union = reduce(DataFrame.unionByName, [x.select("qid", F.col("id").cast("string").alias("id"), "rank", first(i).alias("first")) for i, x in enumerate(lists)])
    dealt = union if parts is None else union.repartition(parts, "qid", "id")
    scores = dealt.groupBy("qid", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min("first").alias("first"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "first", "id")
    out = scores.withColumn("rank", F.row_number().over(order).cast("long")).drop("first")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def quota(ranked: DataFrame, most: int, limited: Column) -> DataFrame:
    """All rows that are not limited, and of those that are the first most of each query in rank order."""
    n = F.row_number().over(Window.partitionBy("qid", limited).orderBy("rank"))
    return ranked.withColumn("_n", n).filter(~limited | (F.col("_n") <= most)).drop("_n")


def budget(ranked: DataFrame, tokens: int, cost) -> DataFrame:
    """The rows of each query, in rank order, up to the first that goes over the budget; 0: no limit."""
    if not tokens:
        return ranked
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_sum", F.sum(cost).over(w)).filter(F.col("_sum") <= tokens).drop("_sum")


def ordered_union(lists: list[DataFrame]) -> DataFrame:
    """(qid, id, rank): ids of the lists one after the other, each at its first place; ties go to the smaller id."""
    tagged = [x.select("qid", "id", F.struct(F.lit(i).alias("list"), "rank").alias("at")) for i, x in enumerate(lists)]
    first = reduce(DataFrame.unionByName, tagged).groupBy("qid", "id").agg(F.min("at").alias("at"))
    return first.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id")).cast("long").alias("rank"))


def time_weighted(ranked: DataFrame, start: int, end: int) -> DataFrame:
    """Rows (qid, id, event_time) ordered anew: those within the window first, then the latest."""
    w = Window.partitionBy("qid").orderBy(F.col("event_time").between(start, end).desc(), F.col("event_time").desc(), "id")
    return ranked.withColumn("rank", F.row_number().over(w).cast("long"))


def session_budget(hits: DataFrame, slots: int) -> DataFrame:
    """Slots for each session of a query: by hits times distinct query tokens covered, in proportion, one at least.

    hits: (qid, session, id, covered), covered the query tokens that a hit has. What rounding leaves over
    goes to the densest sessions.
    """
    dense = hits.groupBy("qid", "session").agg((F.count(F.lit(1)) * F.size(F.array_distinct(F.flatten(F.collect_list("covered"))))).alias("weight"))
    w = Window.partitionBy("qid")
    share = F.greatest(F.lit(1), F.floor(F.lit(slots) * F.col("weight") / F.nullif(F.sum("weight").over(w), F.lit(0))))
    given = dense.withColumn("slots", F.coalesce(share, F.lit(1)).cast("long"))
    left = F.lit(slots) - F.sum("slots").over(w)
    place = F.row_number().over(w.orderBy(F.col("weight").desc(), "session"))
    return given.withColumn("slots", F.col("slots") + F.when(place <= left, 1).otherwise(0))


def expand_sessions(hits: DataFrame, chunks: DataFrame, queries: DataFrame, slots: int) -> DataFrame:
    """(qid, id, session, rank): the turns of the sessions that a query's hits (qid, id) lie in, slots of them a query.

    A session is the first two parts of a chunk's id; ids of earlier expansions do not count. Sessions rank by
    hits times distinct query tokens in the hit turns (one at least), then by name, and get slots in proportion,
    one at least, for their first turns; slots left over go to further turns of the first sessions. A query
    without tokens fills sessions in order of their hits. Queries: (qid, query).
    """
    parts = F.split("id", "::")
    number = F.expr("try_cast(element_at(split(id, '::'), -1) as bigint)")
    turns = chunks.filter(F.size(parts) >= 2).withColumn("session", F.array_join(F.slice(parts, 1, 2), "::"))
    asked = queries.select("qid", F.array_distinct(tx.tokens(F.col("query"))).alias("asked"))
    texts = turns.select("id", "session", tx.tokens(F.col("text")).alias("tokens"))
    found = hits.select("qid", "id").filter(~F.contains("id", F.lit("::session_expansion"))).join(texts, "id").join(asked, "qid")
    by_session = found.groupBy("qid", "session").agg(F.count(F.lit(1)).alias("hits"))
    covered = found.select("qid", "session", F.explode(F.array_intersect("tokens", "asked")).alias("token")).groupBy("qid", "session").agg(F.count_distinct("token").alias("covered"))
    weight = F.col("hits") * F.greatest(F.coalesce("covered", F.lit(0)), F.lit(1))
    ranked = by_session.join(covered, ["qid", "session"], "left").join(asked.select("qid", (F.size("asked") > 0).alias("_any")), "qid").withColumn("weight", weight)

    w = Window.partitionBy("qid")
    upto = w.orderBy(F.col("weight").desc(), "session").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.when(F.col("_any"), F.greatest(F.lit(1), F.floor(slots * F.col("weight") / F.sum("weight").over(w)))).otherwise(0)
    sizes = turns.join(ranked.select("session").distinct(), "session", "left_semi").groupBy("session").agg(F.count(F.lit(1)).alias("size"))
    plan = ranked.join(sizes, "session").withColumn("place", F.row_number().over(w.orderBy(F.col("weight").desc(), "session"))).withColumn("take", F.least(wanted, "size").cast("long"))
    within = lambda c, most: F.least(most, F.sum(c).over(upto)) - F.least(most, F.sum(c).over(upto) - F.col(c))
    plan = plan.withColumn("first", within("take", F.lit(slots).cast("long"))).withColumn("more", F.col("size") - F.col("first"))
    plan = plan.withColumn("left", F.lit(slots) - F.sum("first").over(w)).withColumn("extra", within("more", F.col("left"))).select("qid", "session", "place", "first", "extra").filter("first + extra > 0")

    order = F.row_number().over(Window.partitionBy("session").orderBy(F.col("number").asc_nulls_last(), "id"))
    placed = turns.select("id", "session", number.alias("number")).join(plan.select("session").distinct(), "session", "left_semi").withColumn("n", order)
    rows = plan.join(placed, "session").filter("n <= first + extra")
    return rows.select("qid", "id", "session", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n") > F.col("first"), "place", "n")).cast("long").alias("rank"))
