"""Hashes that the JVM has no expression for, as vectorised Arrow functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the 64-bit FNV-1a hash.
_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(text: str) -> int:
    h = _OFFSET
    for b in text.encode():
        h = (h ^ b) * _PRIME & _MASK
    return h


@lru_cache(maxsize=200_000)
def _word_bits(word: str) -> bytes:
    return fnv1a(word).to_bytes(8, "little") + fnv1a(word + "#2").to_bytes(8, "little")


def simhash128(text: str | None) -> str | None:
    """32 hex digits: bit i is set if more words have it set than not, words in lower case; the high half hashes the word with '#2'."""
    if text is None:
        return None
    words = text.lower().split()
    rows = np.frombuffer(b"".join(map(_word_bits, words)), np.uint8).reshape(-1, 16)
    ones = np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(words), bitorder="little")[::-1].tobytes().hex()


@F.pandas_udf(StringType())
def simhash(text: pd.Series) -> pd.Series:
    return text.map(simhash128)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 32-digit codes."""
    half = lambda c, at: F.conv(F.substring(c, at, 16), 16, -10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 17).bitwiseXOR(half(b, 17)))


def near_duplicates(codes, radius: int = 2):
    """(a, b, distance), a < b, of rows (id, code) that differ in at most radius bits.

    Codes are cut into radius + 2 blocks; two such codes agree in two blocks at least, and pairs meet on those.
    """
    from itertools import combinations

    blocks = radius + 2
    width = 32 // blocks
    cut = [F.substring("code", 1 + i * width, width if i < blocks - 1 else 32) for i in range(blocks)]
    keys = F.array(*[F.concat_ws(":", F.lit(f"{i}-{j}"), cut[i], cut[j]) for i, j in combinations(range(blocks), 2)])
    rows = codes.select("id", "code", F.explode(keys).alias("key"))
    other = rows.select(F.col("id").alias("b"), F.col("code").alias("_code"), "key")
    pairs = rows.select(F.col("id").alias("a"), "code", "key").join(other, "key").filter("a < b").select("a", "b", "code", "_code").distinct()
    return pairs.select("a", "b", hamming(F.col("code"), F.col("_code")).alias("distance")).filter(F.col("distance") <= radius)


def classes_and_pairs(codes, radius: int = 2, salts: int = 64):
    """(kind, a, b, distance) of rows (id, code): a member row for every row, b in the class a at distance 0, and a pair row for two classes a < b within radius.

    A class is all rows of one code, named by its smallest id. Classes return to rows by code and salt, so a code with many rows is spread.
    """
    from tracewell.session import materialise

    rows = materialise(codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))), "simhash")
    parts = rows.groupBy("code", "salt").agg(F.min("id").alias("a"))
    classes = parts.groupBy("code").agg(F.min("a").alias("a"))
    named = parts.select("code", "salt").join(classes, "code")
    members = rows.join(named, ["code", "salt"]).select(F.lit("member").alias("kind"), "a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    pairs = near_duplicates(classes.select(F.col("a").alias("id"), "code"), radius)
    return members.unionByName(pairs.select(F.lit("pair").alias("kind"), "a", "b", F.col("distance").cast("int")))


def redact(text: Column) -> Column:
    """API keys, bearer tokens, passwords and private key headers as [REDACTED]; white space is collapsed where anything was replaced."""
    mark = "[REDACTED]"
    out = F.regexp_replace(text, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", mark)
    out = F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]{8,}", mark)
    out = F.regexp_replace(out, r"(?i)\b(bearer)\s+\S+", "$1 " + mark)
    out = F.regexp_replace(out, r"(?i)\b(password|passwd)\s*[=:]\s*\S+", "$1=" + mark)
    return F.when(out == text, text).otherwise(F.trim(F.regexp_replace(out, r"\s+", " ")))


#: Numbers of 64 bits that a set's signature has.
SIGNS = 8


def signature(words: Column, name: str) -> list[Column]:
    """The parity of a set's words at each of 64 SIGNS hashed bits, as numbers name0, name1 and on."""
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * SIGNS)))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    return [F.aggregate(F.filter(at, lambda h: F.floor(h / 64) == k), F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(bit(h))).alias(f"{name}{k}") for k in range(SIGNS)]


def unlike(a: str, b: str) -> Column:
    """Bits in which signatures a and b differ: two sets differ in as many words at least."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(SIGNS)), F.lit(0))
