"""Chains of causes and effects: self-joins as deep as asked, pruned by the running product of confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import materialise

#: Fixed value: chains that a query returns at most.
CHAINS = 50


def _hop(e: str = "") -> Column:
    return F.struct(*[F.col(e + c).alias(c) for c in ("id", "from_id", "to_id", "relation", "confidence", "outcome_polarity")])


def chains(edges: DataFrame, anchors: DataFrame, backward: bool, max_depth: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """(qid, depth, confidence, hops, at) of every chain from the anchor edges (qid, id) on.

    A chain grows by valid edges of at least min_confidence while the product stays there too. There is
    no guard against loops but the depth. hops holds a struct per edge, in the order walked; at is the
    chain's open end. Each level is written to the shared folder.
    """
    step = edges.filter((F.col("valid_to").isNull()) & (F.col("confidence") >= min_confidence)).select(
        F.col("to_id" if backward else "from_id").alias("_near"), F.col("from_id" if backward else "to_id").alias("_far"), F.col("confidence").alias("_c"), _hop().alias("_hop"), F.col("id").alias("_edge")
    )
    level = step.join(anchors.select("qid", F.col("id").alias("_edge")), "_edge").select("qid", F.col("_c").alias("confidence"), F.array("_hop").alias("hops"), F.col("_far").alias("at"))
    levels = [level]
    for _ in range(max_depth - 1):
        product = F.col("confidence") * F.col("_c")
        level = level.join(step, F.col("at") == F.col("_near")).filter(product >= min_confidence).select("qid", product.alias("confidence"), F.concat("hops", F.array("_hop")).alias("hops"), F.col("_far").alias("at"))
        level = materialise(level, "chains")  # else each level is computed again for every deeper one
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).withColumn("depth", F.size("hops").cast("long"))


def _path() -> Column:
    return F.array_join(F.transform("hops", lambda h: h.id.cast("string")), ">")


def best(found: DataFrame, limit: int = CHAINS, min_depth: int = 1) -> DataFrame:
    """The deepest, then surest chains of each query, with path (edge ids) and rank."""
    rows = found.filter(F.col("depth") >= min_depth).withColumn("path", _path())
    order = Window.partitionBy("qid").orderBy(F.col("depth").desc(), F.round("confidence", 9).desc(), "path")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def cause_chains(edges: DataFrame, anchors: DataFrame, max_depth: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """Backward chains of two edges or more."""
    return best(chains(edges, anchors, True, max_depth, min_confidence), min_depth=2)


def effect_chains(edges: DataFrame, anchors: DataFrame, max_depth: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """Forward chains."""
    return best(chains(edges, anchors, False, max_depth, min_confidence))


def session_chains(edges: DataFrame, nodes: DataFrame, max_depth: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """Backward chains that end in a node (qid, node, tag), over edges of its task tag alone."""
    own = edges.join(nodes.select("qid", "node", "tag"), (F.col("to_id") == F.col("node")) & F.col("task_tag").eqNullSafe(F.col("tag"))).select("qid", "id")
    tagged = own.join(edges.select("id", "task_tag"), "id")
    found = [chains(edges, tagged.select("qid", "id"), True, max_depth, min_confidence)]
    tags = nodes.select("qid", F.col("tag").alias("_tag")).distinct()
    of = edges.select(F.col("id").alias("_id"), F.col("task_tag").alias("_own"))
    rows = found[0].withColumn("path", _path())
    foreign = rows.select("qid", "path", F.explode("hops").alias("h")).join(of, F.col("h.id") == F.col("_id")).join(tags, "qid").filter(~F.col("_own").eqNullSafe(F.col("_tag"))).select("qid", "path").distinct()
    return best(rows.join(foreign, ["qid", "path"], "left_anti"))


def bridges(meta: DataFrame, nodes: DataFrame, min_confidence: float = 0.0, limit: int = 20) -> DataFrame:
    """Valid meta edges at a node (qid, node): (qid, node, other, id, confidence, rank), the surest first."""
    live = meta.filter("valid_to is null").filter(F.col("confidence") >= min_confidence)
    both = live.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), "id", "confidence").unionByName(live.filter("from_id <> to_id").select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), "id", "confidence"))
    order = Window.partitionBy("qid", "node").orderBy(F.col("confidence").desc(), "id")
    return both.join(nodes, "node").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def cross_session(edges: DataFrame, meta: DataFrame, anchors: DataFrame, max_depth: int = 3, min_confidence: float = 0.5, max_bridges: int = 3, limit: int = 20) -> DataFrame:
    """Backward chains carried on in other sessions: (qid, first_edge, second_edge, confidence, rank).

    A chain's root, the decision of its last hop, meets a node of another session by a meta edge; the
    best chain that ends there follows. Confidence is the product of all three. All chains are tried; one
    without such a meeting stays alone, second_edge null and confidence its own. Only the ranking is limited.
    """
    walked = chains(edges, anchors, True, max_depth, min_confidence).withColumn("first_edge", F.element_at("hops", 1)["id"])
    first = walked.groupBy("qid", "first_edge", F.col("at").alias("node")).agg(F.max("confidence").alias("c1"))
    over = bridges(meta, first.select("qid", "node").distinct(), 0.0, max_bridges).select("qid", "node", "other", F.col("confidence").alias("c2"))
    tag = edges.filter("valid_to is null").select("from_id", "to_id", "task_tag")
    root_tag = tag.groupBy("from_id").agg(F.min("task_tag").alias("own")).withColumnRenamed("from_id", "node")
    starts = edges.filter("valid_to is null").select(F.col("to_id").alias("other"), F.col("id").alias("_e"), "task_tag")
    second_at = over.join(root_tag, "node", "left").join(starts, "other").filter(~F.col("task_tag").eqNullSafe(F.col("own"))).select("qid", "node", "other", "c2", F.col("_e").alias("id"))
    second = chains(edges, second_at.select("qid", "id").distinct(), True, max_depth, min_confidence).select("qid", F.element_at("hops", 1)["id"].alias("second_edge"), F.col("confidence").alias("c3"))
    best_second = second.groupBy("qid", "second_edge").agg(F.max("c3").alias("c3"))
    carried = second_at.withColumnRenamed("id", "second_edge").join(best_second, ["qid", "second_edge"])
    joined = first.join(carried.groupBy("qid", "node", "second_edge").agg(F.max(F.col("c2") * F.col("c3")).alias("c23")), ["qid", "node"], "left")
    scored = joined.groupBy("qid", "first_edge", "second_edge").agg(F.max(F.col("c1") * F.coalesce("c23", F.lit(1.0))).alias("confidence"))
    order = Window.partitionBy("qid").orderBy(F.round("confidence", 9).desc(), "first_edge", F.col("second_edge").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def latest_tag(edges: DataFrame) -> DataFrame:
    """(node, task_tag): the tag of the latest valid edge at a node."""
    ends = edges.filter("valid_to is null").select(F.explode(F.array("from_id", "to_id")).alias("node"), "task_tag", "event_time", "id")
    return ends.groupBy("node").agg(F.max_by("task_tag", F.struct("event_time", "id")).alias("task_tag"))
