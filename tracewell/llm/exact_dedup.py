"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import arrays
from tracewell.llm.grouping import attach, join_counted
from tracewell.session import materialise

#: The characters that do not count when texts are compared.
IGNORED = b" \t\n\x0b\x0c\r"


def content_hash(content: bytes) -> bytes:
    """The 128-bit group key."""
    return hashlib.md5(content, usedforsecurity=False).digest()


def _points(raw: bytes) -> int:
    return len(raw.decode("utf-8", "replace"))


def _digests(docs: DataFrame, hash_of: Callable[[bytes], bytes]) -> DataFrame:
    """Row of (_id, _points, _hash, _sha) for each of (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            points, key, sha = [], [], []
            for a, b in zip(at, at[1:]):
                content = raw[a:b].translate(None, IGNORED)
                points.append(_points(raw[a:b]))
                key.append(hash_of(content))
                sha.append(hashlib.sha256(content).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.int64()), pa.array(key, pa.binary()), pa.array(sha, pa.string())], names=["_id", "_points", "_hash", "_sha"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _points long, _hash binary, _sha string")


def _contents(docs: DataFrame, hash_of: Callable[[bytes], bytes]) -> DataFrame:
    """Row of (_id, _points, _hash, _content, _sha) for each of (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            content = [raw[a:b].translate(None, IGNORED) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_points(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64()), pa.array(map(hash_of, content), pa.binary()), pa.array(content, pa.binary()), pa.array([hashlib.sha256(c).hexdigest() for c in content], pa.string())],
                names=["_id", "_points", "_hash", "_content", "_sha"],
            )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _points long, _hash binary, _content binary, _sha string")


def _decide(rows: DataFrame, key: str) -> DataFrame:
    """keep_id, group_size and kept for rows (_row, a number of their own) grouped by key: most code points, then smallest id, nulls last; of repeated rows one is kept."""
    best = F.min(F.struct((-F.col("_points")).alias("points"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    joined = attach(rows, key, "_row", {"_n": F.count(F.lit(1)), "_best": best}, {"group_size": F.sum("_n"), "_best": F.min("_best")})
    return joined.withColumns({"keep_id": F.col("_best.id"), "kept": F.col("_row") == F.col("_best.row")})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[bytes], bytes] = content_hash) -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when the same after dropping the characters of [\\x20\\x09-\\x0D]; a null counts as
    empty, so nulls and blank texts form one group. Of a group the row with the most code points in the
    original text stays, then the smallest id; a null id comes last. Of wholly repeated rows one stays. Ids may
    be of any type with an order.
    Returns a row per input row: the id, keep_id, group_size, kept, text_sha256 (of the normalised text)
    and text_hash (the group key). Other columns are left out; an empty table gives an empty table.

    Rows are grouped by a 128-bit hash. Then the bytes of all rows in groups of two or more are compared,
    by grouping on hash and content (combined before the shuffle, so a large group moves one row a task);
    a hash with several contents has its rows grouped by content instead.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    digests = materialise(_digests(named, hash_of).withColumn("_row", F.monotonically_increasing_id()), "exact-dedup-digests")
    rows = materialise(_decide(digests, "_hash").drop("_best", "_salt"), "exact-dedup")
    shared = materialise(rows.filter("group_size > 1").select(F.col("_id").alias("_member")).distinct(), "exact-dedup-members")
    members = join_counted(named, shared, F.col("_id").eqNullSafe(F.col("_member")), "left_semi", shared.count())
    contents = _contents(members, hash_of)
    kinds = contents.groupBy("_hash", "_content").agg(F.count(F.lit(1)).alias("_n")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_kinds"))
    collided = materialise(kinds.filter("_kinds > 1").select("_hash"), "exact-dedup-collisions")
    if not collided.isEmpty():
        again = materialise(contents.join(collided, "_hash", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "exact-dedup-again")
        apart = _decide(again.withColumn("_key", F.struct("_hash", "_content")), "_key")
        rows = rows.join(collided, "_hash", "left_anti").unionByName(apart.select(*rows.columns))
    return rows.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"), F.col("_hash").alias("text_hash"))
