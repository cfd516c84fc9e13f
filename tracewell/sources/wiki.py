"""A store as a folder of linked notes: one a node, one a fact, and an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx

#: Signs of the relations.
SIGNS = {"caused": "→", "enabled": "⇒", "prevented": "⊣", "no_effect": "·"}
#: Connections on one note; those of a node with more go on over further notes.
CONNECTIONS = 500


def slug(text: Column, name: Column) -> Column:
    """Letters and digits of the first 60 characters, 50 at most, with a hash of the name behind, which tells equal texts apart."""
    words = F.trim(F.regexp_replace(F.substring(text, 1, 60), r"[^\p{L}\p{N}]+", " "))
    return F.concat(F.substring(F.lower(F.replace(words, F.lit(" "), F.lit("-"))), 1, 50), F.lit("-"), F.substring(F.md5(name.cast("string")), 1, 16))


def _percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("long").cast("string"), F.lit("%"))


def notes(entries: DataFrame) -> DataFrame:
    """(path, page) of the nodes of entries: what each is connected with, the surest first, CONNECTIONS on a note.

    The place of a connection among those of its node comes from counts of parts, so no task sorts all connections of a hub.
    """
    side = lambda own, own_text, to, other: entries.select(F.col(own).alias("node"), F.col(own_text).alias("text"), F.col(to).alias("to"), F.col(other).alias("other"), "id", "relation", "confidence", "task_tag", "discovered_by")
    rows = side("from_id", "decision", "to_id", "outcome").withColumn("way", F.lit(0)).unionByName(side("to_id", "outcome", "from_id", "decision").withColumn("way", F.lit(1)))
    level = F.least(F.lit(999), F.floor(F.col("confidence") * 1000)).cast("int")
    cut = rows.withColumn("_level", -level)
    sizes = cut.groupBy("node", "_level").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("node").orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy("node", "_level").orderBy(F.desc("confidence"), "id", "way"))
    placed = cut.withColumn("_in", within).join(before, ["node", "_level"]).withColumn("place", F.col("_in") + F.col("_before") - 1)
    sign = F.lit("—")
    for relation, mark in SIGNS.items():
        sign = F.when(F.col("relation") == relation, mark).otherwise(sign)
    line = F.concat(F.lit("- **"), "relation", F.lit("** "), sign, F.lit(" [["), slug(F.col("other"), F.col("to")), F.lit("|"), tx.truncate(F.col("other"), 60), F.lit("]] ("), _percent(F.col("confidence")), F.lit(" confidence)"))
    details = F.concat(F.lit("| Field | Value |\n|---|---|\n| Task | "), F.coalesce("task_tag", F.lit("—")), F.lit(" |\n| Relation | "), "relation", F.lit(" |\n| Confidence | "), _percent(F.col("confidence")), F.lit(" |\n| Source | "), "discovered_by", F.lit(" |\n"))
    part = placed.withColumn("part", F.floor(F.col("place") / CONNECTIONS))
    listed = part.groupBy("node", "text", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x.line), "\n").alias("lines"), F.min_by(details, "place").alias("details"))
    head = F.concat(F.lit('---\nid: "'), "node", F.lit('"\n---\n\n## '), "text", F.lit("\n\n### Connections\n\n"), "lines", F.lit("\n\n### Details\n\n"), "details")
    name = F.concat(slug(F.col("text"), F.col("node")), F.when(F.col("part") > 0, F.concat(F.lit("-"), (F.col("part") + 1).cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    return listed.select(name.alias("path"), head.alias("page"))


def fact_notes(facts: DataFrame) -> DataFrame:
    """(path, page) of valid facts; of facts with one value in several keys or scopes each has its own."""
    front = F.concat(F.lit('---\nkey: "'), "key", F.lit('"\nscope: "'), "scope", F.lit('"\nconfidence: '), F.format_string("%.2f", F.col("confidence")), F.lit("\n---\n\n## "), "value")
    page = F.concat(front, F.lit("\n\n- **Category**: "), "key", F.lit("\n- **Scope**: "), "scope", F.lit("\n- **Source**: "), F.coalesce("source", F.lit("—")), F.lit("\n"))
    return facts.filter("valid_to is null").select(F.concat(F.lit("Facts/"), slug(F.col("value"), F.col("id")), F.lit(".md")).alias("path"), page.alias("page"))


def vault(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, page) of all notes and README.md, which says how much there is."""
    nodes = entries.select(F.explode(F.array("from_id", "to_id")).alias("node")).agg(F.count_distinct("node").alias("n"))
    counts = entries.agg(F.count(F.lit(1)).alias("e")).crossJoin(nodes).crossJoin(facts.filter("valid_to is null").agg(F.count(F.lit(1)).alias("f")))
    said = F.concat(F.lit("# Vault\n\n"), "e", F.lit(" causal edges across "), "n", F.lit(" nodes.\n"), "f", F.lit(" facts.\n\n"), F.lit(", ".join(f"{mark} {relation}" for relation, mark in SIGNS.items())), F.lit("\n"))
    return notes(entries).unionByName(fact_notes(facts)).unionByName(counts.select(F.lit("README.md").alias("path"), said.alias("page")))


def write_vault(entries: DataFrame, facts: DataFrame, root: str) -> None:
    """Writes all notes as rows of JSON lines by path; a step outside Spark unpacks them into files where single files are wanted."""
    vault(entries, facts).write.json(root)
