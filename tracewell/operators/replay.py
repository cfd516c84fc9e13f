"""Consolidation of a graph by replay: paths that are walked grow, all else fades, and what is faint, unused and old goes. Every change is logged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import blocks
from tracewell.operators.graph import GC, LTD, LTP, MAX_HOPS, WEIGHT_CAP
from tracewell.session import materialise, release

#: Replays beyond which a node's edges fade half as fast, and seconds without use that make a node dormant.
PROTECTED_FROM, DORMANT = 3, 30 * 86400
#: Walks of one part in which an edge's passes are numbered; parts are added up before.
WALKS = 4096


def walks(graph: DataFrame, starts: DataFrame, steps: int = MAX_HOPS) -> DataFrame:
    """(walk, step, src, dst) of walks (walk, node) along the first valid caused edge (smallest id) of each node, of steps edges at most; a walk ends before a node it has been at."""
    first = materialise(graph.filter("valid and relation = 'caused'").groupBy("src").agg(F.min_by("dst", "id").alias("dst")), "walk-steps")
    at, taken = starts.select("walk", "node", F.array("node").alias("path")), []
    for step in range(1, steps + 1):
        hop = at.select("walk", "node", "path").join(first, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        at = materialise(hop.select("walk", F.lit(step).alias("step"), "src", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "walk")
        taken.append(at.select("walk", "step", "src", F.col("node").alias("dst")))
        if at.isEmpty():
            break
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def consolidate(graph: DataFrame, nodes: DataFrame, starts: DataFrame, now: int | None = None, steps: int = MAX_HOPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, nodes, log) after a replay of the walks from starts (walk, node), numbered by walk.

    graph: (id, src, dst, relation, weight, valid); nodes: (node, replay_count, last_activated). A pass strengthens the edge of smallest id between the two
    nodes by LTP, to WEIGHT_CAP at most; every node of a walk of two or more counts one replay more. Then all valid edges
    fade by LTD, half as fast where their first node has over PROTECTED_FROM replays. Then valid edges under GC become invalid
    whose first node has no replay at all and was last active over DORMANT seconds before now (now null: whenever).

    log: (seq, op, id, node, old_value, new_value), op one of ltp, replay, ltd, gc. Applied in the order of seq it makes the new graph
    from the old one: see apply_log. What is to be swapped in can so be looked at before.
    """
    path = materialise(walks(graph, starts, steps), "replay-walks")
    target = graph.groupBy("src", "dst").agg(F.min_by(F.struct("id", "weight"), "id").alias("e"))
    passes = path.join(target, ["src", "dst"]).select("walk", "step", F.col("src").alias("node"), F.col("e.id").alias("id"), F.col("e.weight").alias("weight"))
    passed = _numbered(materialise(passes, "replay-passes"), "id", ["walk", "step"])
    after = lambda n: F.least(F.lit(WEIGHT_CAP), F.col("weight") * F.pow(F.lit(LTP), n))
    ltp = passed.select(F.struct(F.lit(0).alias("phase"), F.col("walk").alias("walk"), F.lit(0).alias("part"), F.col("step").cast("long").alias("at")).alias("order"), F.lit("ltp").alias("op"), "id", "node", F.when(F.col("n") == 1, F.col("weight")).otherwise(after(F.col("n") - 1)).alias("old_value"), after(F.col("n")).alias("new_value"))
    ltp = materialise(ltp, "replay-ltp")
    begun = path.filter("step = 1").select("walk", F.lit(0).alias("step"), F.col("src").alias("node"))
    seen = begun.unionByName(path.select("walk", "step", F.col("dst").alias("node")))
    counted = _numbered(materialise(seen, "replay-seen"), "node", ["walk", "step"]).join(nodes.select("node", "replay_count"), "node", "left")
    had = F.coalesce("replay_count", F.lit(0))
    replays = counted.select(F.struct(F.lit(0).alias("phase"), "walk", F.lit(1).alias("part"), F.col("step").cast("long").alias("at")).alias("order"), F.lit("replay").alias("op"), F.lit(None).cast(graph.schema["id"].dataType).alias("id"), "node", (had + F.col("n") - 1).cast("double").alias("old_value"), (had + F.col("n")).cast("double").alias("new_value"))
    replays = materialise(replays, "replay-counts")
    new_nodes = nodes.join(replays.groupBy("node").agg(F.count(F.lit(1)).alias("_more")), "node", "left").withColumn("replay_count", F.col("replay_count") + F.coalesce("_more", F.lit(0))).drop("_more")
    new_nodes = materialise(new_nodes, "replay-nodes")

    strong = ltp.groupBy("id").agg(F.max("new_value").alias("_strong"), F.count(F.lit(1)).alias("replays"))
    state = new_nodes.select(F.col("node").alias("src"), F.col("replay_count").alias("_count"), F.col("last_activated").alias("_last"))
    rows = graph.join(strong, "id", "left").join(state, "src", "left").withColumn("_old", F.coalesce("_strong", "weight"))
    faded = F.col("_old") * (1 - (1 - LTD) * F.when(F.coalesce("_count", F.lit(0)) > PROTECTED_FROM, 0.5).otherwise(1.0))
    dormant = F.lit(True) if now is None else F.coalesce(F.lit(now) - F.col("_last") > DORMANT, F.lit(True))
    rows = rows.withColumn("_new", F.when(F.col("valid"), faded).otherwise(F.col("_old")))
    rows = rows.withColumn("_gone", F.col("valid") & (F.abs("_new") < GC) & (F.coalesce("_count", F.lit(0)) == 0) & dormant)
    rows = materialise(rows.withColumn("replays", F.coalesce("replays", F.lit(0))), "replay-edges")
    late = lambda phase: F.struct(F.lit(phase).alias("phase"), F.lit(None).cast(path.schema["walk"].dataType).alias("walk"), F.lit(0).alias("part"), F.col("id").cast("long").alias("at")).alias("order")
    ltd = rows.filter(F.col("valid") & (F.abs(F.col("_old") - F.col("_new")) > 1e-9)).select(late(1), F.lit("ltd").alias("op"), "id", F.col("src").alias("node"), F.col("_old").alias("old_value"), F.col("_new").alias("new_value"))
    gc = rows.filter("_gone").select(late(2), F.lit("gc").alias("op"), "id", F.col("src").alias("node"), F.col("_new").alias("old_value"), F.lit(0.0).alias("new_value"))
    log = ltp.unionByName(replays).unionByName(ltd).unionByName(gc)
    log = blocks.numbered(log, "order").select(F.col("place").alias("seq"), "op", "id", "node", "old_value", "new_value")
    columns = [c for c in graph.columns if c not in ("weight", "valid")]
    out = rows.select(*columns, F.col("_new").alias("weight"), (F.col("valid") & ~F.col("_gone")).alias("valid"), F.col("replays").cast("long").alias("replays"))
    release(path)
    return out, new_nodes, log


def _numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with n, the place of each among those of its key, from 1; the walks of a key are taken in parts of WALKS, so no task has all rows of a key."""
    cut = rows.withColumn("_part", F.floor(F.col("walk") / WALKS))
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return cut.withColumn("_in", within).join(ahead, [key, "_part"]).withColumn("n", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def apply_log(graph: DataFrame, log: DataFrame) -> DataFrame:
    """The graph with the changes of a log (of ltp, ltd and gc) made."""
    last = log.filter("id is not null").groupBy("id").agg(F.max_by("new_value", F.when(F.col("op") != "gc", F.col("seq"))).alias("_w"), F.bool_or(F.col("op") == "gc").alias("_gone"))
    made = graph.join(last, "id", "left").withColumns({"weight": F.coalesce("_w", "weight"), "valid": F.col("valid") & ~F.coalesce("_gone", F.lit(False))})
    return made.drop("_w", "_gone")
