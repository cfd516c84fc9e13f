"""Group facts brought back to every row without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of a key are dealt; one key with a third of all rows then puts 1/192 of them in a task.
SALTS = 64
#: A side with no more rows than this (counted, not estimated) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def attach(rows: DataFrame, key: str, spread: str, partial: dict[str, Column], final: dict[str, Column], per_key=None) -> DataFrame:
    """rows with the columns of final, computed over all rows of equal key.

    partial aggregates rows by key and salt (a hash of the column spread), final aggregates those by key,
    so no exchange carries a hot key to one task: rows meet their group's facts by key and salt.
    per_key, if given, maps the table of keys and facts before it is joined. Null keys form no group.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int"))
    parts = salted.filter(F.col(key).isNotNull()).groupBy(key, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    facts = parts.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])
    if per_key is not None:
        facts = per_key(facts)
    spread_facts = parts.select(key, "_salt").join(facts, key)
    return salted.join(spread_facts, [key, "_salt"], "left")


def join_counted(left: DataFrame, right: DataFrame, on, how: str, right_rows: int) -> DataFrame:
    """A join whose right side is broadcast only if its counted rows are few; the same rows come out either way."""
    return left.join(F.broadcast(right) if right_rows <= BROADCAST_ROWS else right, on, how)
