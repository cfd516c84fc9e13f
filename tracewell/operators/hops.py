"""Neighbourhoods of edges in the experience graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators.bm25 import over_rows, overlaps, pruned, top
from tracewell.session import materialise


def ends(edges: DataFrame, *columns: str) -> DataFrame:
    """A row per end of an edge: node, and these columns (a loop has one end)."""
    return edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node"), *columns)


def touching(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with an end among nodes (qid, node), by confidence, then id; a row (qid, id, confidence, rank) once for each query."""
    found = ends(edges, "id", "confidence").join(nodes, "node").select("qid", "id", "confidence").distinct()
    return top(found, limit or 2**31 - 1, F.col("confidence").desc(), "id")


def touching_by_activation(edges: DataFrame, activation: DataFrame, limit: int) -> DataFrame:
    """Of the max(2 limit, 10) surest edges that touch activated nodes (qid, node, activation) the limit most activated."""
    most = ends(edges, "id", "confidence").join(activation, "node").groupBy("qid", "id", "confidence").agg(F.max(F.abs("activation")).alias("activation"))
    sure = top(most, max(2 * limit, 10), F.col("confidence").desc(), "id").drop("rank")
    return top(sure, limit, F.round("activation", 9).desc(), F.col("confidence").desc(), "id")


def hop_expansion(entries: DataFrame, seeds: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(qid, id, hop, overlap, confidence, rank): edges a hop from the seeds (qid, id), and two hops over distilled ones.

    Second hops need a token in common with the query. All first hops come before second ones; each by
    shared tokens, confidence and id.
    """
    at = ends(entries, "id", "confidence", "discovered_by")
    texts = entries.select("id", F.array_distinct(tx.tokens(F.concat_ws(" ", "decision", "outcome"))).alias("tokens"))
    asked = queries.select("qid", F.array_distinct(tx.tokens(F.col("query"))).alias("asked"))
    around = lambda of: at.select("node", F.col("id").alias("_from")).join(of, F.col("_from") == F.col("id")).select("qid", "node").distinct()
    one = at.join(around(seeds), "node").select("qid", "id", "confidence").distinct().join(seeds, ["qid", "id"], "left_anti").withColumn("hop", F.lit(1))
    known = seeds.select("qid", "id").unionByName(one.select("qid", "id"))
    two = at.filter("discovered_by = 'distill'").join(around(one.select("qid", "id")), "node").select("qid", "id", "confidence").distinct().join(known, ["qid", "id"], "left_anti").withColumn("hop", F.lit(2))
    both = one.unionByName(two).join(texts, "id").join(asked, "qid").withColumn("overlap", F.size(F.array_intersect("tokens", "asked")).cast("long"))
    return top(both.filter("hop = 1 or overlap > 0").drop("tokens", "asked"), limit, "hop", F.col("overlap").desc(), F.col("confidence").desc(), "id")


def markov_blanket(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(id, is_seed, confidence, rank): the seed edges, valid or not, then valid edges that share an end with one, the surest first."""
    own = edges.join(seeds, "id", "left_semi").select("id", "confidence", F.lit(True).alias("is_seed"))
    near = ends(edges.join(seeds, "id", "left_semi")).select("node").distinct()
    rest = ends(edges.filter("valid_to is null"), "id", "confidence").join(near, "node", "left_semi").select("id", "confidence").distinct().join(seeds, "id", "left_anti").withColumn("is_seed", F.lit(False))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("is_seed").desc(), F.when(~F.col("is_seed"), -F.col("confidence")), "id")
    ranked = own.unionByName(rest).orderBy(F.col("is_seed").desc(), F.when(~F.col("is_seed"), -F.col("confidence")), "id").limit(limit)
    return ranked.withColumn("rank", F.row_number().over(order).cast("long"))


def entity_search(entries: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(qid, id, overlap, rank): edges by how many of the query's entities their texts name, then id.

    Edges that name the same are a class, and so are queries. A class of edges goes by its smallest id and keeps its first limit; classes
    meet as bm25.pruned says, and each of a query's best limit classes is then replaced by its edges.
    """
    names = lambda text: F.array_sort(F.array_distinct(tx.entity_tokens(text))).alias("names")
    first = Window.partitionBy("names").orderBy("id")
    kept = entries.select("id", names(F.concat_ws(" ", "decision", "outcome"))).filter(F.size("names") > 0).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit)
    kept = materialise(kept, "entity-classes")
    held = materialise(kept.filter("n = 1").select("id", F.explode("names").alias("term"), F.lit(1.0).alias("part")), "entity-postings")
    known = held.select("term").distinct()
    asked = queries.select("qid", names(F.col("query"))).select("qid", F.explode("names").alias("term")).join(known, "term", "left_semi")
    asked = materialise(asked.groupBy("qid").agg(F.array_sort(F.collect_list("term")).alias("names")), "entity-asked")
    classes = asked.groupBy("names").agg(F.min("qid").alias("qid"))
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.lit(1.0).alias("most"))
    scores = pruned(classes.select("qid", F.explode("names").alias("term"), F.lit(1.0).alias("w")), terms, *over_rows(held), limit)
    best = overlaps(scores, limit).drop("rank")
    members = kept.select(F.first("id").over(first).alias("_class"), F.col("id").alias("_id"))
    rows = best.join(members, F.col("id") == F.col("_class")).select("qid", F.col("_id").alias("id"), "overlap")
    ranked = top(rows, limit, F.col("overlap").desc(), "id").withColumnRenamed("qid", "_of")
    return asked.join(classes.withColumnRenamed("qid", "_of"), "names").select("qid", "_of").join(ranked, "_of").select("qid", "id", "overlap", "rank")


def analogues(entries: DataFrame, meta: DataFrame, seeds: DataFrame, query: str, limit: int) -> DataFrame:
    """Edges that touch what is similar_to the seeds' nodes (node), by tokens shared with the query."""
    pairs = meta.filter("relation = 'similar_to' and valid_to is null")
    both = pairs.select(F.col("from_id").alias("node"), F.col("to_id").alias("other")).unionByName(pairs.select(F.col("to_id").alias("node"), F.col("from_id").alias("other")))
    near = both.join(seeds, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seeds, "node", "left_anti")
    asked = F.array_distinct(tx.tokens(F.lit(query)))
    rows = ends(entries, "id", "decision", "outcome", "confidence").join(near, "node", "left_semi").dropDuplicates(["id"])
    scored = rows.select("id", F.size(F.array_intersect(tx.tokens(F.concat_ws(" ", "decision", "outcome")), asked)).cast("long").alias("overlap"), F.lit(0).alias("qid"))
    return top(scored, limit, F.col("overlap").desc(), "id").drop("qid")
