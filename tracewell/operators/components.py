"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import materialise, release


#: Edges (counted) up to which the smallest neighbour of every node is sent to all tasks; there are twice as many nodes at most.
BROADCAST_EDGES = 200_000
#: Parts into which the edges of a node are dealt beyond that.
SALTS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """Edges (a, b) with m, the smallest b of their a. No task gathers the edges of one node."""
    if few:
        return edges.join(F.broadcast(edges.groupBy("a").agg(F.min("b").alias("m"))), "a")
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = salted.groupBy("a", "_salt").agg(F.min("b").alias("m"))
    return salted.join(parts.select("a", "_salt").join(parts.groupBy("a").agg(F.min("m").alias("m")), "a"), ["a", "_salt"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Edges may be repeated, directed either way, or loops; null ends are ignored. Rounds grow with the
    logarithm of the longest path, and every round's edges are written to the shared folder, as is the result. A
    node with many edges has them dealt over tasks.
    """
    clean = materialise(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "components-edges")
    now = materialise(clean.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = _state(now)
    while True:
        few = state[0] <= BROADCAST_EDGES
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, few).withColumn("m", F.least("a", "m")).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large, few).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, now = now, materialise(small.filter("a <> b").distinct(), "components")
        last, state = state, _state(now)
        release(before)
        if state == last:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rest = now.select(F.col("b").alias("node")).unionByName(clean.filter("a = b").select(F.col("a").alias("node")))  # the smallest of each component, and loops
    alone = rest.distinct().join(nodes.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    out = materialise(nodes.unionByName(alone), "components-found")
    release(clean, now)
    return out
