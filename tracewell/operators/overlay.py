"""A graph that takes changes between rebuilds: a base, and an overlay of patches that spreading reads along with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import graph
from tracewell.operators.bm25 import sent
from tracewell.operators.inverted import InvertedIndex
from tracewell.session import materialise
from tracewell.sources.commits import Store

#: Patches that an overlay holds; the batch that takes it beyond is folded into the base. So the overlay goes to all tasks.
PATCHES = 100_000

_PATCH = "seq long, op string, src string, dst string, relation string, weight double"


@dataclass(frozen=True)
class GraphOverlay:
    """One version of a graph over (src, dst, relation, weight, valid) in a versioned store.

    Patches: an appended edge holds for its two nodes (the last one of them counts), beside what the base has between
    them; edges between two nodes can be made invalid, which patches after it are not touched by; a node can be retired:
    it seeds nothing and is in no result, while its edges pass on what they get, until the next fold removes them. An
    edge appended to a retired node brings it back. index, over chunks (id, text), is what facts are linked by.
    """

    store: Store
    index: InvertedIndex | None = None

    @staticmethod
    def create(spark: SparkSession, root: str, base: DataFrame, index: InvertedIndex | None = None) -> GraphOverlay:
        rows = base.select("src", "dst", "relation", "weight", "valid")
        return GraphOverlay(Store.open(spark, root).publish(replace={"base": rows, "patches": spark.createDataFrame([], _PATCH)}, properties={"patches": 0}), index)

    @staticmethod
    def open(spark: SparkSession, root: str, index: InvertedIndex | None = None, version: int | None = None) -> GraphOverlay:
        return GraphOverlay(Store.open(spark, root, version), index)

    def _patched(self, rows: DataFrame) -> GraphOverlay:
        new = materialise(rows.select(F.lit(self.store.version).cast("long").alias("seq"), "op", "src", "dst", "relation", "weight"), "graph-patches")
        held = self.store.properties["patches"] + new.count()
        out = GraphOverlay(self.store.publish(append={"patches": new}, properties={"patches": held}), self.index)
        return out.fold() if held > PATCHES else out

    def append_edges(self, edges: DataFrame) -> GraphOverlay:
        """With edges (src, dst, relation, weight); of several between two nodes the one of the greatest weight, then relation."""
        best = edges.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "weight"), F.struct("weight", "relation")).alias("e"))
        return self._patched(best.select(F.lit("edge").alias("op"), "src", "dst", "e.relation", F.col("e.weight").cast("double").alias("weight")))

    def invalidate(self, pairs: DataFrame) -> GraphOverlay:
        """Without all edges from src to dst, of the base and of earlier patches, for pairs (src, dst)."""
        return self._patched(pairs.select("src", "dst").distinct().select(F.lit("void").alias("op"), "src", "dst", F.lit("").alias("relation"), F.lit(0.0).alias("weight")))

    def retire(self, nodes: DataFrame) -> GraphOverlay:
        """With nodes (node) retired."""
        return self._patched(nodes.select("node").distinct().select(F.lit("retire").alias("op"), F.col("node").alias("src"), F.col("node").alias("dst"), F.lit("").alias("relation"), F.lit(0.0).alias("weight")))

    def link_facts(self, facts: DataFrame, min_tokens: int = 3, df_limit: int = 20, most: int = 8) -> GraphOverlay:
        """With edges both ways between new facts (id, key, value, scope, confidence) and the indexed chunks that share tokens with them, and from the fact's scope to it.

        As graph.entity_links does over all chunks, from the index's blocks of the facts' tokens alone.
        """
        words = F.array_distinct(tx.tokens(F.concat(F.translate("key", "_", " "), F.lit(" "), "value")))
        asked = materialise(facts.select(F.concat(F.lit("fact:"), "id").alias("fact"), F.explode(words).alias("term")), "link-terms")
        blocks = self.index._blocks_of(asked.select("term"))
        rare = blocks.groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("df") <= df_limit).select("term")
        held = blocks.join(rare, "term").select("term", F.explode("postings.id").alias("chunk"))
        shared = held.join(sent(asked, asked.count()), "term").groupBy("fact", "chunk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_tokens)
        best = shared.withColumn("_k", F.row_number().over(Window.partitionBy("fact").orderBy(F.desc("n"), "chunk"))).filter(F.col("_k") <= most)
        weight = F.least(F.lit(0.8), 0.3 + 0.1 * F.col("n")).alias("weight")
        link = lambda a, b: best.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit("fact").alias("relation"), weight)
        own = facts.select(F.concat(F.lit("scope:"), "scope").alias("src"), F.concat(F.lit("fact:"), "id").alias("dst"), F.lit("fact").alias("relation"), F.col("confidence").cast("double").alias("weight"))
        return self.append_edges(link("fact", "chunk").unionByName(link("chunk", "fact")).unionByName(own))

    def _overlay(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Patched edges that are valid, voided pairs, and retired nodes; PATCHES rows at most in all but the batch that is folded."""
        p = self.store.table("patches")
        void = p.filter("op = 'void'").groupBy("src", "dst").agg(F.max("seq").alias("_void"))
        edges = p.filter("op = 'edge'").groupBy("src", "dst").agg(F.max_by(F.struct("relation", "weight"), "seq").alias("e"), F.max("seq").alias("_seq"))
        edges = edges.join(F.broadcast(void), ["src", "dst"], "left").filter("_void is null or _void < _seq")
        touched = edges.select(F.explode(F.array("src", "dst")).alias("node"), "_seq").groupBy("node").agg(F.max("_seq").alias("_seq"))
        gone = p.filter("op = 'retire'").groupBy(F.col("src").alias("node")).agg(F.max("seq").alias("_gone")).join(F.broadcast(touched), "node", "left")
        return edges.select("src", "dst", "e.relation", "e.weight", F.lit(True).alias("valid")), void, gone.filter("_seq is null or _seq < _gone").select("node")

    def edges(self) -> DataFrame:
        """All edges as they are now: (src, dst, relation, weight, valid)."""
        added, void, _ = self._overlay()
        base = self.store.table("base").join(F.broadcast(void), ["src", "dst"], "left").withColumn("valid", F.col("valid") & F.col("_void").isNull()).drop("_void")
        return base.unionByName(added)

    def retired(self) -> DataFrame:
        return self._overlay()[2]

    def spread(self, seeds: DataFrame, **options) -> DataFrame:
        """graph.spread over the edges as they are now; retired nodes are neither seeds nor results."""
        gone = materialise(self.retired(), "graph-retired")
        found = graph.spread(self.edges(), seeds.join(F.broadcast(gone), "node", "left_anti"), **options)
        return found.join(F.broadcast(gone), "node", "left_anti")

    def fold(self) -> GraphOverlay:
        """With the patches in the base, and retired nodes and their edges gone: what a rebuild gives."""
        gone = materialise(self.retired(), "graph-retired")
        kept = self.edges().join(F.broadcast(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(F.broadcast(gone.withColumnRenamed("node", "dst")), "dst", "left_anti")
        return GraphOverlay(self.store.publish(replace={"base": kept.select("src", "dst", "relation", "weight", "valid"), "patches": self.store.spark.createDataFrame([], _PATCH)}, properties={"patches": 0}), self.index)
