"""How new what happened is, how far evidence agrees, and what retrieval should no longer say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.session import materialise

#: What counts as a surprise, and the band in which the hybrid measure asks for a prediction.
SURPRISE, BAND = 0.5, (0.4, 0.7)


def replay_entropy(nodes: DataFrame) -> DataFrame:
    """One row: entropy in bits, over 3, of nodes (replay_count) in 8 buckets by powers of two."""
    bucket = F.least(F.lit(7), F.floor(F.log2(F.col("replay_count") + 1)))
    counts = nodes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).agg(F.coalesce(F.sum(-share * F.log2(share)) / 3, F.lit(0.0)).alias("novelty"))


def prediction_gap(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, surprise, novel): 1 less the best word overlap of what happened (id, text) with the predictions for it (id, text)."""
    joined = actual.join(predicted.select("id", F.col("text").alias("_p")), "id", "left")
    best = joined.groupBy("id").agg(F.max(F.when(F.col("_p").isNull(), 0.0).otherwise(tx.text_jaccard(F.col("text"), F.col("_p")))).alias("best"))
    return best.select("id", (1 - F.col("best")).alias("surprise"), (F.round(1 - F.col("best"), 9) > SURPRISE).alias("novel"))


def hybrid(rows: DataFrame, predicted: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(verdicts, counts): the surprise of rows (id, decision, text) by the predictions that are there (id, text), and where that is within BAND by one that is asked for.

    predict gets the rows within BAND alone, (id, decision), and returns (id, text); where it gives no row or a null, the first verdict stands; of several the
    smallest text counts. verdicts: (id, surprise, novel, asked); counts: one row with rows, asked and answered.
    """
    first = materialise(prediction_gap(rows.select("id", "text"), predicted), "novelty-first")
    near = F.round("surprise", 9).between(*BAND)
    asked = materialise(rows.join(first.filter(near).select("id"), "id", "left_semi").select("id", "decision"), "novelty-asked")
    told = materialise(predict(asked).filter("text is not null").groupBy("id").agg(F.min("text").alias("_told")), "novelty-told")
    again = rows.select("id", "text").join(told, "id").select("id", (1 - tx.text_jaccard(F.col("text"), F.col("_told"))).alias("_s"))
    out = first.join(again, "id", "left").withColumns({"asked": near, "surprise": F.coalesce("_s", "surprise")})
    verdicts = out.select("id", "surprise", (F.round("surprise", 9) > SURPRISE).alias("novel"), "asked")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return verdicts, one(first, "rows").crossJoin(one(asked, "asked")).crossJoin(one(told, "answered"))


def agreement(rows: DataFrame) -> DataFrame:
    """(qid, agreement): mean Jaccard similarity of all pairs of a question's results (qid, id, text); 1 for a single one.

    Results with equal token sets are counted once each with their number, so pairs are formed of different
    sets only; copies agree wholly with each other, those without tokens too.
    """
    sets = rows.select("qid", F.array_sort(F.array_distinct(tx.tokens(F.col("text")))).alias("t")).groupBy("qid", "t").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: sets.select("qid", F.col("t").alias(f"t{s}"), F.col("n").alias(f"n{s}"))
    alike = F.col("na") * (F.col("na") - 1) / 2
    value = F.when(F.col("ta") == F.col("tb"), alike).otherwise(F.col("na") * F.col("nb") * tx.jaccard(F.col("ta"), F.col("tb")))
    total = side("a").join(side("b"), "qid").filter("ta <= tb").groupBy("qid").agg(F.sum(value).alias("s"))
    size = sets.groupBy("qid").agg(F.sum("n").alias("n"))
    return size.join(total, "qid").select("qid", F.when(F.col("n") < 2, 1.0).otherwise(F.col("s") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))).alias("agreement"))


# Phrases that take something back, with what they take back.
_TOPICS = [r"no longer (?:likes|wants|uses|eats|plays) ([a-z0-9]+)", r"switched from ([a-z0-9]+) to", r"used to (?:like|want|use|eat|play) ([a-z0-9]+)"]
_HISTORY = ["used to", "previously", "before", "history", "in the past", "formerly"]


def without_retracted(results: DataFrame, questions: DataFrame) -> DataFrame:
    """results (qid, id, text) less retractions, and less texts with a topic that a result of the same question takes back.

    A question (qid, query) about history keeps all.
    """
    low = F.lower("text")
    past = questions.select("qid", F.regexp_like(F.lower("query"), F.lit("|".join(_HISTORY))).alias("_past"))
    rows = results.join(past, "qid", "left").withColumn("_past", F.coalesce("_past", F.lit(False)))
    topics = rows.filter("not _past").select("qid", F.explode(F.array(*[F.regexp_extract(low, p, 1) for p in _TOPICS])).alias("topic")).filter("topic <> ''").distinct()
    hit = rows.join(topics, "qid").filter(F.contains(low, F.col("topic"))).select("qid", "id").distinct()
    kept = rows.join(hit, ["qid", "id"], "left_anti")
    return kept.filter(F.col("_past") | ~tx.is_retraction(F.col("text"))).select("qid", "id", "text")
