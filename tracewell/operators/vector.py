"""Searches by cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.bm25 import top
from tracewell.operators.nearest import near


_ADD = lambda s, x: s + x


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), _ADD)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """In double precision; 0 for vectors that differ in length, are empty or have no norm. Norms that are known are not computed again."""
    zero, size = F.lit(0.0), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), _dot(a, b) / F.nullif(size, zero)).otherwise(zero)


def semantic(items: DataFrame, queries: DataFrame, limit: int, min_similarity: float | None = None) -> DataFrame:
    """(qid, id, similarity, rank) of the items (id, vector) nearest to each query (qid, query_vector).

    Each query row meets every item, which is what exact search means, in blocks and tiles; each sends on its own best
    alone. The threshold applies after the cut to limit rows.
    """
    found = near(items.select("id", "vector"), queries.select("qid", "query_vector"), "id", "qid", limit).select("qid", "id", "similarity")
    out = top(found, limit, F.round("similarity", 9).desc(), "id")
    return out if min_similarity is None else out.filter(F.col("similarity") >= min_similarity)


def entity_boosted(items: DataFrame, queries: DataFrame, limit: int, boost: float = 0.5) -> DataFrame:
    """As semantic, over items (id, vector, entities) and queries (qid, query_vector, query_entities): similarity grows by boost for each shared entity."""
    found = near(items.select("id", "vector", "entities"), queries.select("qid", "query_vector", "query_entities"), "id", "qid", limit, boost=("entities", "query_entities", boost))
    return top(found.select("qid", "id", "similarity"), limit, F.round("similarity", 9).desc(), "id")
