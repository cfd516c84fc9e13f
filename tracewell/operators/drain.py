"""Sessions that wait to be distilled, until one before them is alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.blocks import numbered
from tracewell.operators.nearest import near
from tracewell.session import materialise, release


def _recurring(sessions: DataFrame, least: float) -> DataFrame:
    """(session_id, prior, similarity) of waiting sessions that are to be distilled, prior null for those without a vector.

    One at a time in order, a session goes if it is alike to one distilled before, in this batch too. In rounds, those
    still open are held against what the round before has reached, of which they need one alike before them; and at the end what is reached
    against all that is, for its nearest. Pairs that are alike are never kept, so a large cluster costs its comparisons alone.
    """
    told = sessions.filter("vector is not null")
    waiting = numbered(told.filter("not distilled"), "begun", "session_id").select("session_id", F.col("vector"), F.col("place").alias("at"))
    waiting = materialise(waiting, "drain-waiting")
    fresh = materialise(told.filter("distilled").select("session_id", "vector", F.lit(0).cast("long").alias("at")), "drain-fresh")
    reached, open_ = [fresh], waiting
    prior = lambda rows: rows.select(F.col("session_id").alias("prior"), "vector", F.col("at").alias("_at"))
    asked = lambda rows: rows.select("session_id", F.col("vector").alias("query_vector"), "at")
    while True:
        met = materialise(near(prior(fresh), asked(open_), "prior", "session_id", 1, least, ("_at", "at")).select("session_id").distinct(), "drain-met")
        if met.isEmpty():
            break
        fresh = materialise(open_.join(met, "session_id", "left_semi").select(*waiting.columns), "drain-fresh")
        open_ = materialise(open_.join(met, "session_id", "left_anti").select(*waiting.columns), "drain-open")
        reached.append(fresh)
    every = reduce(DataFrame.unionByName, reached)
    pairs = near(prior(every), asked(reduce(DataFrame.unionByName, reached[1:], waiting.limit(0))), "prior", "session_id", 1, least, ("_at", "at"))
    best = Window.partitionBy("session_id").orderBy(F.round("similarity", 9).desc(), "prior")
    found = pairs.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("session_id", "prior", "similarity")
    eager = sessions.filter("not distilled and vector is null").select("session_id", F.lit(None).cast("long").alias("prior"), F.lit(None).cast("double").alias("similarity"))
    out = materialise(found.unionByName(eager), "drain-found")
    release(waiting, *reached)
    return out


def drain(turns: DataFrame, distil: Callable[[DataFrame], DataFrame], now: int, least: float, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, items, outcome) after the sessions that recur were given to distil.

    turns: (session_id, turn_index, speaker, text, event_time, embedding, distilled_at), a session's embedding on its turn 0. Waiting
    sessions are taken in the order of their first turns (ties by id), limit of them at most. One whose embedding has a cosine of at least
    least with a session distilled before it, in this batch too, is distilled together with the nearest of those (ties: smallest
    id), whose turns come first; one without an embedding is distilled alone; all others go on waiting.

    distil gets all their turns at once, (session_id, place, speaker, text, date), place numbering what is to be read together
    as session_id, and returns items. Marks: distilled_at becomes now for the distilled and what they were merged with, where it is null; so a second
    run has nothing to do with them. outcome: (session_id, distilled, prior, similarity) of every session that was taken.
    """
    first = lambda c: F.max(F.when(F.col("turn_index") == 0, F.col(c)))
    sessions = turns.groupBy("session_id").agg(F.min("event_time").alias("begun"), first("embedding").alias("vector"), F.bool_and(F.col("distilled_at").isNotNull()).alias("distilled"))
    if limit is not None:
        taken = sessions.filter("not distilled").orderBy("begun", "session_id").limit(limit)
        sessions = sessions.filter("distilled").unionByName(taken)
    sessions = materialise(sessions, "drain-sessions")
    found = _recurring(sessions, least)
    merged = found.filter("prior is not null").select("session_id", F.col("prior").alias("_of"), F.lit(0).alias("_part")).unionByName(found.select("session_id", F.col("session_id").alias("_of"), F.lit(1).alias("_part")))
    dates = sessions.select("session_id", F.to_date(F.timestamp_seconds("begun")).cast("string").alias("date"))
    said = turns.select(F.col("session_id").alias("_of"), "turn_index", "speaker", "text").join(merged, "_of").join(dates, "session_id")
    items = distil(said.select("session_id", F.struct("_part", "turn_index").alias("place"), "speaker", "text", "date"))
    marks = found.select("session_id").unionByName(found.filter("prior is not null").select(F.col("prior").alias("session_id"))).distinct().withColumn("_mark", F.lit(now).cast("long"))
    marked = turns.join(marks, "session_id", "left").withColumn("distilled_at", F.coalesce("distilled_at", "_mark")).select(*turns.columns)
    outcome = sessions.filter("not distilled").select("session_id").join(found.withColumn("distilled", F.lit(True)), "session_id", "left")
    return marked, items, outcome.select("session_id", F.coalesce("distilled", F.lit(False)).alias("distilled"), "prior", "similarity")
