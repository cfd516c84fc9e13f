"""Export and import of a store as JSON lines, snapshots, and pages for reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.hashing import redact
from tracewell.schema import SCHEMA_VERSION, TABLES, ensure_schema
from tracewell.sources import commits

FORMAT_VERSION = 1


def export(chunks: DataFrame, edges: DataFrame, meta: DataFrame, path: str, task_tag: str | None = None, min_confidence: float = 0.0, since: int | None = None, include_invalidated: bool = False, hide_secrets: bool = False) -> None:
    """Writes a header, the chunks that edges use, the edges and the meta edges, a JSON object a line."""
    kept = edges.filter(F.col("confidence") >= min_confidence)
    if not include_invalidated:
        kept = kept.filter("valid_to is null")
    if task_tag is not None:
        kept = kept.filter(F.col("task_tag") == task_tag)
    if since is not None:
        kept = kept.filter(F.col("event_time") >= since)
    used = kept.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    nodes = chunks.join(used, "id", "left_semi")
    if hide_secrets:
        nodes = nodes.withColumn("text", redact(F.col("text")))
    text = nodes.select("id", "text")
    ends = lambda df: df.join(text.select(F.col("id").alias("from_id"), F.col("text").alias("from_text")), "from_id").join(text.select(F.col("id").alias("to_id"), F.col("text").alias("to_text")), "to_id")
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns)).alias("value"))
    header = chunks.sparkSession.range(1).select(F.to_json(F.struct(F.lit("header").alias("type"), F.lit(FORMAT_VERSION).alias("format_version"), F.lit(SCHEMA_VERSION).alias("schema_version"))).alias("value"))
    reduce(DataFrame.unionByName, [header, line(nodes, "chunk"), line(ends(kept), "edge"), line(ends(meta), "meta_edge")]).write.text(path)


_LINE = "type string, format_version int, id string, text string, from_text string, to_text string, relation string, confidence double, event_time long, task_tag string, outcome_polarity string, discovered_by string, pattern string, valid_to long"


def read_export(spark: SparkSession, path: str, chunks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new chunks, new edges, report) of an export against a store; edges known by texts, relation and event time are left out.

    report: one row with bad lines, and chunks and edges that are new. Nothing is changed here, so a dry
    run is a look at the report.
    """
    rows = spark.read.text(path).select(F.from_json("value", _LINE).alias("j"))
    good = rows.filter("j.type is not null").select("j.*")
    texts = good.filter("type = 'chunk'").select("text").distinct()
    new_chunks = texts.join(chunks.select("text"), "text", "left_anti").select(F.concat(F.lit("imp"), F.md5("text")).alias("id"), "text")
    have = chunks.select("id", "text")
    known = edges.join(have.select(F.col("id").alias("from_id"), F.col("text").alias("from_text")), "from_id").join(have.select(F.col("id").alias("to_id"), F.col("text").alias("to_text")), "to_id")
    keys = ["from_text", "to_text", "relation", "event_time"]
    new_edges = good.filter("type = 'edge'").dropDuplicates(keys).join(known.select(*keys), keys, "left_anti").select(*keys, "confidence", "task_tag", "outcome_polarity", "discovered_by", "valid_to")
    report = rows.agg(F.count_if(F.col("j.type").isNull()).alias("bad_lines")).crossJoin(new_chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(new_edges.agg(F.count(F.lit(1)).alias("edges")))
    return new_chunks, new_edges, report


def save_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Writes the tables as a version of a store; it is seen whole or not at all, and never changed. A version that is there already is refused."""
    spark = next(iter(tables.values())).sparkSession
    commits.Store(spark, root.rstrip("/")).publish(replace={name: ensure_schema(df, name) for name, df in tables.items()}, version=version)


def load_snapshot(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, or of the latest; a store of an older schema gets the columns it lacks."""
    store = commits.Store.open(spark, root, version)
    return {name: ensure_schema(store.table(name), name) for name in TABLES if name in store.folders}


def pages(entries: DataFrame, most: int = 50) -> DataFrame:
    """(node text, page): a Markdown page per end of an edge, with what led to it and what came of it, the surest first."""
    out = entries.select(F.col("decision").alias("node"), F.struct(-F.col("confidence"), F.concat(F.lit("- "), "relation", F.lit(" → "), "outcome")).alias("line"), F.lit("out").alias("side"))
    into = entries.select(F.col("outcome").alias("node"), F.struct(-F.col("confidence"), F.concat(F.lit("- "), "relation", F.lit(" ← "), "decision")).alias("line"), F.lit("in").alias("side"))
    lines = out.unionByName(into)
    listed = lambda side: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("line")))), 1, most), lambda x: x["col2"]), "\n")
    return lines.groupBy("node").agg(F.concat(F.lit("# "), "node", F.lit("\n\n## Led to\n"), listed("out"), F.lit("\n\n## Came from\n"), listed("in")).alias("page"))
