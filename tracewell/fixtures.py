"""The driver's tables seen as an experience store: one rule a table, in Spark here and in SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2025-01-01 UTC, the time that queries take as now.
NOW = 1_735_689_600
RELATIONS = ["caused", "enabled", "prevented", "no_effect"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer parts than there are cores is dealt out, as a small single file is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "conversations", "embeddings") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node per turn of a conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("::s0::"), "turn").alias("id"), F.concat("role", F.lit(": "), "text").alias("text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"),
        (F.lit(0.2) + (F.col("conv_id") * 3 + F.col("turn")) % 7 / 10).alias("q_value"),
    )


def _case(number: Column, options: list) -> Column:
    out = F.lit(options[-1])
    for i, o in reversed(list(enumerate(options[:-1]))):
        out = F.when(number == i, F.lit(o)).otherwise(out)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each turn to the next of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c, t = F.col("conv_id"), F.col("turn")
    return (
        table(spark, sf_dir, "conversations").withColumn("before", F.lag("turn").over(w)).filter("before is not null").select(
            (c * 100 + t).alias("id"), F.concat(F.lit("c"), c, F.lit("::s0::"), "before").alias("from_id"), F.concat(F.lit("c"), c, F.lit("::s0::"), t).alias("to_id"),
            _case((c + t) % 4, RELATIONS).alias("relation"), (F.lit(0.3) + (c * 7 + t * 13) % 70 / 100).alias("confidence"),
            F.when((c + t) % 3 == 0, F.lit("distill")).otherwise(F.lit("agent")).alias("discovered_by"), (c * 1000 + t).alias("event_time"), (F.lit(NOW) - (c * 37 + t) % 200 * 86400).alias("discovered_at"),
            F.when((c + t) % 11 == 0, F.lit(NOW)).cast("long").alias("valid_to"), F.concat(F.lit("t"), c % 5).alias("task_tag"), ((c + 2 * t) % 4).alias("access_count"),
            F.when((c + t) % 2 == 0, F.lit(NOW) - (c + t) % 20 * 86400).cast("long").alias("last_accessed_at"),
            _case((c * 3 + t) % 5, ["positive", "negative", "mixed", "neutral", None]).alias("outcome_polarity"), F.when((c + t) % 22 == 0, c * 100 + t + 1).cast("long").alias("superseded_by"),
        )
    )


def meta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from the first turn of a conversation to the third turn of the third next one."""
    first = table(spark, sf_dir, "conversations").filter("turn = 0 and conv_id % 3 = 0")
    c = F.col("conv_id")
    return first.select(c.alias("id"), F.concat(F.lit("c"), c, F.lit("::s0::0")).alias("from_id"), F.concat(F.lit("c"), c + 3, F.lit("::s0::2")).alias("to_id"),
                        _case(c % 4, ["similar_to", "repeated", "contradicts", "refines"]).alias("relation"), F.concat(F.lit("pattern "), c % 10).alias("pattern"), (F.lit(0.4) + c % 6 / 10).alias("confidence"), F.when(c % 7 == 0, F.lit(NOW)).cast("long").alias("valid_to"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact per customer: its market segment."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("market_segment_"), k % 50).alias("key"), F.col("c_mktsegment").alias("value"),
        F.when(k % 3 == 0, F.lit("user")).otherwise(F.concat(F.lit("tenant:"), "c_nationkey")).alias("scope"), (F.lit(0.3) + k % 7 / 10).alias("confidence"), (F.lit(NOW) - k * 3600).alias("updated_at"), F.when(k % 13 == 0, F.lit(NOW)).cast("long").alias("valid_to"),
        F.when(k % 2 == 0, F.lit("agent")).otherwise(F.lit("tool")).alias("source"), (F.lit(NOW) - k * 7200).alias("created_at"), F.when(k % 26 == 0, k + 1).cast("long").alias("superseded_by"), F.lit(None).cast("string").alias("embedding_model"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each event to the next of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return (
        e.withColumn("before", F.lag("event_id").over(w)).filter("before is not null").select(
            F.col("event_id").alias("id"), F.col("before").alias("from_id"), F.col("event_id").alias("to_id"),
            F.when(kind == "error", "caused").when(kind == "purchase", "enabled").when(kind == "signup", "prevented").otherwise("no_effect").alias("relation"),
            (F.lit(0.5) + F.col("event_id") % 50 / 100).alias("confidence"), F.unix_timestamp("ts").alias("event_time"), kind.alias("task_tag"),
            F.when(kind == "error", "negative").when(kind == "purchase", "positive").alias("outcome_polarity"), F.lit(None).cast("long").alias("valid_to"), "user_id",
        )
    )


#: The same tables as common table expressions.
SQL = {
    "chunks": "chunks AS (SELECT 'c' || conv_id || '::s0::' || turn AS id, role || ': ' || text AS text, conv_id * 1000 + turn AS created_at, 0.2::DOUBLE + ((conv_id * 3 + turn) % 7)::DOUBLE / 10 AS q_value FROM conversations)",
    "edges": f"""edges AS (SELECT conv_id * 100 + turn AS id, 'c' || conv_id || '::s0::' || before AS from_id, 'c' || conv_id || '::s0::' || turn AS to_id,
        CASE (conv_id + turn) % 4 WHEN 0 THEN 'caused' WHEN 1 THEN 'enabled' WHEN 2 THEN 'prevented' ELSE 'no_effect' END AS relation, 0.3::DOUBLE + ((conv_id * 7 + turn * 13) % 70)::DOUBLE / 100 AS confidence,
        CASE WHEN (conv_id + turn) % 3 = 0 THEN 'distill' ELSE 'agent' END AS discovered_by, conv_id * 1000 + turn AS event_time, {NOW} - (conv_id * 37 + turn) % 200 * 86400 AS discovered_at,
        CASE WHEN (conv_id + turn) % 11 = 0 THEN {NOW} END AS valid_to, 't' || (conv_id % 5) AS task_tag, (conv_id + 2 * turn) % 4 AS access_count,
        CASE WHEN (conv_id + turn) % 2 = 0 THEN {NOW} - (conv_id + turn) % 20 * 86400 END AS last_accessed_at,
        CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' WHEN 3 THEN 'neutral' END AS outcome_polarity, CASE WHEN (conv_id + turn) % 22 = 0 THEN conv_id * 100 + turn + 1 END AS superseded_by
        FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL)""",
    "entries": "entries AS (SELECT e.*, f.text AS decision, t.text AS outcome FROM edges e JOIN chunks f ON f.id = e.from_id JOIN chunks t ON t.id = e.to_id WHERE e.valid_to IS NULL)",
    "meta": f"meta AS (SELECT conv_id AS id, 'c' || conv_id || '::s0::0' AS from_id, 'c' || (conv_id + 3) || '::s0::2' AS to_id, CASE conv_id % 4 WHEN 0 THEN 'similar_to' WHEN 1 THEN 'repeated' WHEN 2 THEN 'contradicts' ELSE 'refines' END AS relation, 'pattern ' || (conv_id % 10) AS pattern, 0.4::DOUBLE + (conv_id % 6)::DOUBLE / 10 AS confidence, CASE WHEN conv_id % 7 = 0 THEN {NOW} END AS valid_to FROM conversations WHERE turn = 0 AND conv_id % 3 = 0)",
    "facts": f"facts AS (SELECT c_custkey AS id, 'market_segment_' || (c_custkey % 50) AS key, c_mktsegment AS value, CASE WHEN c_custkey % 3 = 0 THEN 'user' ELSE 'tenant:' || c_nationkey END AS scope, 0.3::DOUBLE + (c_custkey % 7)::DOUBLE / 10 AS confidence, {NOW} - c_custkey * 3600 AS updated_at, CASE WHEN c_custkey % 13 = 0 THEN {NOW} END AS valid_to, CASE WHEN c_custkey % 2 = 0 THEN 'agent' ELSE 'tool' END AS source, {NOW} - c_custkey * 7200 AS created_at, CASE WHEN c_custkey % 26 = 0 THEN c_custkey + 1 END AS superseded_by FROM customer)",
    "event_edges": "event_edges AS (SELECT event_id AS id, before AS from_id, event_id AS to_id, CASE event_type WHEN 'error' THEN 'caused' WHEN 'purchase' THEN 'enabled' WHEN 'signup' THEN 'prevented' ELSE 'no_effect' END AS relation, 0.5::DOUBLE + (event_id % 50)::DOUBLE / 100 AS confidence, floor(epoch(ts))::BIGINT AS event_time, event_type AS task_tag, CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' END AS outcome_polarity, user_id FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL)",
}


def with_sql(names: str, body: str) -> str:
    """A statement over the named common table expressions, in that order."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body if names else body
