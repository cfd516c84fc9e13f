"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

1. The distinct fingerprints are sorted by their Gray rank over the whole cluster (neighbours then differ in few
   bits) and cut into ranges of about GROUP.
2. A range is a tree (`GrayIndex`). A node holds the bits on which all fingerprints below it agree, less those that
   its parent holds already: a mask and a pattern. The difference of a query to a fingerprint is the sum of
   its differences to the nodes on the way down, so a group is left as a whole once the sum passes the radius.
3. The roots of the ranges are leaves of one more such tree, which names the later ranges that a fingerprint has to
   visit. Ranges visited by many are copied, and the visitors dealt over the copies.

Links go out as a spanning forest of what a task found, so rows grow with fingerprints, not with pairs. No
fingerprint has more than 2,080 others within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import arrays
from tracewell.llm.grouping import attach
from tracewell.llm.jaccard_join import _forest
from tracewell.operators.components import connected_components
from tracewell.session import materialise, release

#: Fingerprints of a range, about; more once there would be over RANGES ranges, so the upper tree is bounded.
GROUP = 16_384
RANGES = 65_536
#: Visitors of one copy of a range.
VISITORS = 1_000_000
#: Children of a node.
FAN = 8
#: Pairs of query and node that are held at a time.
FRONTIER = 1 << 19
#: Shingles whose bits are counted at a time.
ROWS = 1 << 15

_U64 = np.uint64


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code (uint64) in the reflected binary Gray order."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U64(step)
    return rank


def gray_order(code: Column) -> Column:
    """gray_rank of a long as a long whose signed order is that of the ranks."""
    rank = code
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def _majority(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the bits that are set in over half of its hashes; doc is sorted."""
    total = np.zeros((n_docs, 64), np.int64)
    for low in range(0, len(hashes), ROWS):
        owner = doc[low : low + ROWS]
        bits = np.unpackbits(hashes[low : low + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        within = np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))
        cut = np.flatnonzero(within % 255 == 0)  # so many ones fit the bytes that are summed eight at a time
        part = np.add.reduceat(np.ascontiguousarray(bits).view(np.uint64), cut, axis=0).view(np.uint8)
        np.add.at(total, owner[cut], part)
    few = 2 * total > np.bincount(doc, minlength=n_docs)[:, None]
    return np.packbits(few, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(data: np.ndarray, offsets: np.ndarray, k: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints of texts laid end to end: the majority bits of the XXH64 of all k-word shingles, repeats included."""
    n = len(offsets) - 1
    joined, a, b, doc = arrays.joined_words(data, offsets, lower=True)
    count = np.bincount(doc, minlength=n)
    end = (np.cumsum(count))[doc] if len(doc) else doc
    at = np.arange(len(doc))
    first = np.flatnonzero((at + k <= end) | ((at + np.minimum(count[doc], k) == end) & (count[doc] < k)))
    last = np.minimum(first + k, end[first]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[i:j], seed) for i, j in zip(a[first].tolist(), b[last].tolist())), np.uint64, len(first))
    return _majority(hashes, doc[first], n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(_id, code): the 64-bit fingerprint of every row's text as a long; 0 for a text without words or a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(1))
            made = [simhash(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, seed) for i, j in arrays.chunks(offsets)]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(made).view(np.int64))], names=["_id", "code"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, code long")


class GrayIndex:
    """A tree over codes in Gray order, or over groups of them given as patterns of the bits in masks."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None) -> None:
        masks = np.full(len(patterns), ~_U64(0)) if masks is None else masks
        self.size, self.levels = len(patterns), []
        while True:
            cut = np.arange(0, len(patterns), FAN)
            top = len(patterns) <= FAN
            ones = np.bitwise_and.reduceat(patterns, cut)
            shared = np.bitwise_and.reduceat(masks, cut) & ~(ones ^ np.bitwise_or.reduceat(patterns, cut))
            of = np.arange(len(patterns)) // FAN
            self.levels.append((patterns, masks if top else masks & ~shared[of]))
            if top:
                break
            patterns, masks = ones & shared, shared
        self.levels.reverse()

    def within(self, queries: np.ndarray, radius: int, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf), by number, that differ in radius bits or fewer; after: only leaves beyond this number for each query."""
        roots = len(self.levels[0][0])
        step = max(1, FRONTIER // FAN)
        for low in range(0, len(queries), step):
            q = np.repeat(np.arange(low, min(low + step, len(queries))), roots)
            waiting = [(0, q, np.tile(np.arange(roots), len(q) // roots), np.zeros(len(q), np.uint8))]
            while waiting:
                level, q, node, spent = waiting.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    waiting += [(level, q[half:], node[half:], spent[half:]), (level, q[:half], node[:half], spent[:half])]
                    continue
                pattern, mask = self.levels[level]
                spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
                keep = spent <= radius
                below = len(self.levels) - 1 - level
                if after is not None:
                    keep &= (node + 1) * FAN**below - 1 > after[q]
                q, node, spent = q[keep], node[keep], spent[keep]
                if not below:
                    if len(q):
                        yield q, node
                    continue
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = child < len(self.levels[level + 1][0])
                waiting.append((level + 1, np.repeat(q, FAN)[real], child[real], np.repeat(spent, FAN)[real]))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the links a-b between codes."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = _forest(names.view(np.int64), at[: len(a)], at[len(a) :])
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _visits(upper: GrayIndex, parts: np.ndarray, radius: int):
    """Of sorted rows (part, code): (target, own, codes), its own range's codes and those that visit a later range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, code = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            at = np.searchsorted(parts, part)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *upper.within(code, radius, at)]
            who, where = (np.concatenate(x) for x in zip(*found))
            target, own, who = np.concatenate([at, where]), np.repeat([True, False], [len(at), len(where)]), np.concatenate([np.arange(len(at)), who])
            order = np.lexsort((own, target))
            target, own, codes = target[order], own[order], code[who[order]]
            cut = np.concatenate([[0], np.flatnonzero((target[1:] != target[:-1]) | (own[1:] != own[:-1])) + 1])
            ends = np.append(cut[1:], len(target))
            yield pa.RecordBatch.from_arrays([pa.array(parts[target[cut]]), pa.array(own[cut]), pa.array([codes[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], names=["target", "own", "codes"])

    return run


def _verify(radius: int):
    """Links in and into each copy of a range; its own codes come first and are held, visitors stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index, codes = None, [], None, None

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal index, codes
            if held:
                codes = np.concatenate(held)
                codes = codes[np.argsort(gray_rank(codes))]
                index = GrayIndex(codes)
                mine = np.arange(key[1], len(codes), key[2])  # the copies share the links inside
                for q, leaf in index.within(codes[mine], radius, mine):
                    yield _edges(codes[mine[q]], codes[leaf])
                held.clear()

        for batch in batches:
            for target, copy, copies, own, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (target, copy, copies) != key:
                    yield from built()
                    key, index = (target, copy, copies), None
                visitors = np.frombuffer(raw, np.uint64)
                if own:
                    held.append(visitors)
                    continue
                yield from built()
                for q, leaf in index.within(visitors, radius):
                    yield _edges(visitors[q], codes[leaf])
        yield from built()

    return run


def links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct codes (a column code of longs) whose components are those of all pairs within radius bits."""
    spark = codes.sparkSession
    every = materialise(codes.select("code").filter("code is not null").distinct(), "simhash-codes")
    n = every.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    ranges = -(-n // max(GROUP, -(-n // RANGES)))
    ordered = every.withColumn("_rank", gray_order(F.col("code"))).repartitionByRange(ranges, "_rank").sortWithinPartitions("_rank")
    placed = materialise(ordered.select(F.spark_partition_id().cast("long").alias("part"), "code"), "simhash-ranges")
    roots = placed.groupBy("part").agg(F.bit_and("code").alias("ones"), F.bit_or("code").alias("any")).orderBy("part").collect()  # RANGES rows at most
    parts, ones, some = (np.array(x, np.int64) for x in zip(*roots))
    shared = ~(ones ^ some).view(np.uint64)
    upper = GrayIndex(ones.view(np.uint64) & shared, shared)
    visits = materialise(placed.mapInArrow(_visits(upper, parts, radius), "target long, own boolean, codes binary"), "simhash-visits")
    loads = visits.groupBy("target").agg(F.sum(F.when(~F.col("own"), F.octet_length("codes"))).alias("bytes"))
    copies = loads.select("target", F.greatest(F.lit(1), F.ceil(F.coalesce("bytes", F.lit(0)) / (8 * VISITORS))).cast("long").alias("copies"))
    each = visits.join(F.broadcast(copies), "target")  # RANGES rows at most
    copy = F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("codes"), "copies")))
    dealt = each.select("target", F.explode(copy).alias("copy"), "copies", "own", "codes")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges)
    dealt = dealt.repartition(tasks, "target", "copy").sortWithinPartitions("target", "copy", F.desc("own"))
    out = materialise(dealt.mapInArrow(_verify(radius), "a long, b long"), "simhash-links")
    release(every, placed, visits)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """Components of documents whose fingerprints differ in radius bits or fewer.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer than k words has its whole sequence as its
    one shingle; one without words (or null) has fingerprint 0, and is linked like any other. Returns a row
    per input row: the id, code (the fingerprint as a long) and component_id (smallest id reachable, itself
    included; a null id comes after all others). Repeated rows stay repeated; other columns are left out; an empty
    table gives an empty table.
    """
    sig = materialise(fingerprints(docs, id_col, text_col, k), "simhash")
    roots = connected_components(links(sig, radius))

    def per_code(low: DataFrame) -> DataFrame:
        rooted = low.join(roots, F.col("code") == F.col("node"), "left").withColumn("_root", F.coalesce("component", "code"))
        return attach(rooted, "_root", "code", {"_l": F.min("_low")}, {"component_id": F.min("_l")}).select("code", "component_id")

    out = attach(sig, "code", "_id", {"_low": F.min("_id")}, {"_low": F.min("_low")}, per_code)
    return out.select(F.col("_id").alias(id_col), "code", F.coalesce("component_id", "_id").alias("component_id"))
