"""Tables of the experience store, and the view that joins an edge with its two ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Version of the tables, and their columns.
SCHEMA_VERSION = 12
TABLES = {
    "chunks": "id string, text string, created_at long, q_value double, sparse_code string",
    "session_logs": "id string, session_id long, turn_index long, speaker string, text string, event_time long, task_tag string, embedding array<float>, distilled_at long",
    "causal_edges": "id long, from_id string, to_id string, relation string, confidence double, discovered_by string, event_time long, discovered_at long, valid_to long, task_tag string, access_count long, last_accessed_at long, outcome_polarity string, superseded_by long",
    "meta_causal_edges": "id long, from_id string, to_id string, relation string, pattern string, confidence double, discovered_at long, valid_from long, valid_to long, strata_count long, strata array<string>, confounded boolean, simpson boolean",
    "edge_embeddings": "edge_id long, model string, vector array<float>, created_at long",
    "agent_facts": "id long, key string, value string, scope string, source string, confidence double, created_at long, updated_at long, valid_to long, superseded_by long, embedding_model string",
    "agent_facts_embeddings": "fact_id long, model string, vector array<float>, created_at long",
    "bm25_index": "token string, chunk_id string",
    "cooccurrence_edges": "from_id string, to_id string, weight double, updated_at long",
}
_DEFAULTS = {"q_value": 0.5, "access_count": 0, "weight": 0.2, "confidence": 0.5, "relation": "caused", "discovered_by": "agent", "scope": "user"}


def ensure_schema(df: DataFrame, table: str, version: int = SCHEMA_VERSION, extra: bool = False) -> DataFrame:
    """df with the columns of the current version of a table: missing ones get their default, types are cast, others go unless extra.

    Applying it twice changes nothing. Old edges that have only created_at take it as event and discovery time.
    A table of a later version than this is refused.
    """
    if version > SCHEMA_VERSION:
        raise ValueError(f"tables of version {version} are newer than {SCHEMA_VERSION}")
    fields = [f.strip().split(" ", 1) for f in TABLES[table].split(", ")]
    old = {"event_time": "created_at", "discovered_at": "created_at", "updated_at": "created_at", "valid_from": "discovered_at"}
    columns = []
    for name, kind in fields:
        if name in df.columns:
            c = F.col(name)
        elif old.get(name) in df.columns:
            c = F.col(old[name])
        else:
            c = F.lit(_DEFAULTS.get(name))
        columns.append(c.cast(kind).alias(name))
    return df.select(*columns, *([c for c in df.columns if c not in dict(fields)] if extra else []))


def entries(edges: DataFrame, chunks: DataFrame, valid_only: bool = True) -> DataFrame:
    """Edges with the texts of both ends (inner joins, as edges without a chunk at an end do not count)."""
    if valid_only:
        edges = edges.filter("valid_to is null")
    start = chunks.select(F.col("id").alias("from_id"), F.col("text").alias("decision"))
    end = chunks.select(F.col("id").alias("to_id"), F.col("text").alias("outcome"))
    return edges.join(start, "from_id").join(end, "to_id")
