"""What an action led to: outcome distributions, strata, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx

BUCKETS = ("positive", "negative", "mixed", "neutral")


def chain_labels(chains: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Chains with a label by the polarity of their last outcome (id, outcome): SAFE, DANGER, WARNING (mixed) or UNKNOWN.

    A failure after a prevented edge is UNKNOWN too, since the failure did not come to pass.
    """
    last = F.element_at("hops", -1)
    rows = chains.withColumn("_last", last["id"]).join(outcomes.select(F.col("id").alias("_last"), "outcome"), "_last")
    bucket = tx.polarity_bucket(last["outcome_polarity"], F.col("outcome"))
    prevented = F.exists("hops", lambda h: h.relation == "prevented")
    return rows.withColumn("label", F.when(bucket == "positive", "SAFE").when((bucket == "negative") & ~prevented, "DANGER").when(bucket == "mixed", "WARNING").otherwise("UNKNOWN")).drop("_last")


def distribution(evidence: DataFrame, *keys: str) -> DataFrame:
    """Rows by outcome bucket for each key, and a score: +1 a positive, -1 a negative, -0.5 a mixed one. evidence has a column bucket."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    out = evidence.groupBy(*keys).agg(*counts)
    return out.withColumn("score", F.col("positive") - F.col("negative") - 0.5 * F.col("mixed"))


def stratified(evidence: DataFrame, key: str, reference: DataFrame) -> DataFrame:
    """For each key: the pooled distribution, that within the reference tag and that of the others, and whether they disagree in direction.

    evidence: (key, task_tag, bucket); reference: (key, reference). In one pass over the evidence.
    """
    rows = evidence.join(reference, key, "left")
    own = F.col("task_tag").eqNullSafe(F.col("reference"))
    n = lambda b, of: F.count_if((F.col("bucket") == b) & of)
    every = F.lit(True)
    parts = [n(b, of).alias(f"{name}_{b}") for name, of in (("pooled", every), ("within", own), ("others", ~own)) for b in ("positive", "negative")]
    out = rows.groupBy(key).agg(*parts)
    sign = lambda name: F.signum(F.col(f"{name}_positive") - F.col(f"{name}_negative"))
    return out.withColumn("reversed", sign("within") * sign("pooled") < 0)


def modal_tag(evidence: DataFrame, key: str, order: str) -> DataFrame:
    """(key, reference): the most frequent tag, of equals the one first seen last."""
    counts = evidence.groupBy(key, "task_tag").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by("task_tag", F.struct("n", "first")).alias("reference"))


def contrast(evidence: DataFrame, key: str) -> DataFrame:
    """For evidence with a column side (a or b): both distributions and the side with the higher score; none if equal or empty."""
    counts = evidence.groupBy(key).agg(*[F.count_if((F.col("side") == s) & (F.col("bucket") == b)).alias(f"{s}_{b}") for s in "ab" for b in BUCKETS])
    score = lambda s: F.col(f"{s}_positive") - F.col(f"{s}_negative") - 0.5 * F.col(f"{s}_mixed")
    total = lambda s: sum((F.col(f"{s}_{b}") for b in BUCKETS), F.lit(0))
    verdict = F.when((total("a") == 0) | (total("b") == 0) | (score("a") == score("b")), "insufficient").when(score("a") > score("b"), "a").otherwise("b")
    return counts.select(key, score("a").alias("score_a"), score("b").alias("score_b"), verdict.alias("verdict"))


def exposures(attempts: DataFrame) -> DataFrame:
    """(first, n, failures): outcomes of first and repeated exposures, from attempts (subject, at, failed)."""
    rows = attempts.withColumn("first", F.row_number().over(Window.partitionBy("subject").orderBy("at")) == 1)
    return rows.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"))


def loops(commands: DataFrame, least: int = 3) -> DataFrame:
    """(session, start, n, command): runs of at least so many equal commands; commands (session, at, command)."""
    w = Window.partitionBy("session").orderBy("at")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("session", "_c").orderBy("at"))
    rows = commands.withColumn("_c", tx.normalise(F.col("command"))).withColumn("_i", island)
    runs = rows.groupBy("session", "_c", "_i").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= least).select("session", "start", "n", F.col("_c").alias("command"))


def warnings_before(signals: DataFrame) -> DataFrame:
    """Each run's last signal before it: signals (session, at, signal, verdict), a run having a verdict, a warning a signal."""
    w = Window.partitionBy("session").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return signals.withColumn("last_signal", F.last("signal", ignorenulls=True).over(w)).filter("verdict is not null").select("session", "at", "last_signal", "verdict")


def fama(tasks: DataFrame) -> DataFrame:
    """max(0, mpa - lambda (1 - faa)) with lambda = n_forget / (n_keep + n_forget), for each task (task, mpa, faa, n_keep, n_forget)."""
    weight = F.col("n_forget") / F.nullif(F.col("n_keep") + F.col("n_forget"), F.lit(0))
    return tasks.withColumn("fama", F.greatest(F.lit(0.0), F.col("mpa") - F.coalesce(weight, F.lit(0.0)) * (1 - F.col("faa"))))
