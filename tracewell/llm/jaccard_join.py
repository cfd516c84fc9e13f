"""N-gram Jaccard self-join by vertical partitioning.

All distinct shingles have one global order: by how many texts have them (rarest first, counts clipped),
then by hash. The order is cut vertically twice.

1. `_segments` cuts every document's shingle set into fragments by hash range. Each fragment alone counts
   in how many documents its shingles occur, and drops those of one document: they are in no overlap.
2. A document's counts are summed over the fragments. It can have a link only if three quarters of its
   set are shared; what remains is put into the global order, and the prefix filter applies: two linked
   documents share a shingle among the first |x| - ceil(0.75 |x|) + 1 of either.
3. Documents that share a prefix shingle are chained to the smallest one (no pairs are formed), which
   gives candidate blocks. In a block, `_links` cuts the order into fragments again, counts the partial
   overlap of pairs fragment by fragment into one table, and sums; the threshold test is on integers.

Equal sets count as one class throughout, and of the links in a block only a spanning forest is emitted,
so rows grow with documents, not with pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import arrays
from tracewell.llm.grouping import attach
from tracewell.operators.components import connected_components
from tracewell.session import materialise

#: Shingles that a fragment or a bucket of documents holds, about; their number follows from the input.
FRAGMENT_TOKENS = 2_000_000
#: Parts that a task cuts its shingles into at once; more parts are reached in several steps.
FAN_OUT = 512
#: A shingle in so many sets of one chunk is common; its entries skip the fragment's count (see _segments).
COMMON = 48
#: Documents of a candidate block; larger candidate groups become pairs of blocks of near sizes.
BLOCK = 512
#: Shingles of those documents (a single longer one is a part of its own); a task holds two such parts.
BLOCK_TOKENS = 2_000_000
#: Shingles in a fragment of a block's order.
COLUMNS = 2048
#: Rows of a block's table at a time.
ROWS = 128


def _digest(content: bytes) -> bytes:
    """Two hashes of 64 bits of a set: its class and the check of the class."""
    return hashlib.blake2b(content, digest_size=16).digest()


def _sets(column: pa.Array, k: int, apart: frozenset[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: row range, sorted distinct shingle hashes end to end, their offsets, class and check of each row's set.

    Sets whose classes are in apart have their check as class.
    """
    data, offsets = arrays.string_buffers(column)
    for low, high in arrays.chunks(offsets):
        base, n = offsets[low], high - low
        part, at = data[base : offsets[high]], offsets[low : high + 1] - base
        a, b, doc = arrays.words(part, at)
        tokens, owner, _ = arrays.shingle_hashes(arrays.word_hashes(part, a, b), doc, n, k)
        flat, to = arrays.distinct_per_doc(tokens, owner, n)
        raw, ends = flat.tobytes(), (to * 8).tolist()
        both = np.frombuffer(b"".join(_digest(raw[i:j]) for i, j in zip(ends, ends[1:])), np.int64).reshape(-1, 2)
        if apart:
            both = np.where(np.isin(both[:, :1], np.array(sorted(apart), np.int64)), both[:, ::-1], both)
        yield low, high, flat, to, both[:, 0].copy(), both[:, 1].copy()


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, apart: frozenset[int] = frozenset()) -> DataFrame:
    """(_id, n_shingles, class, check) of every row; the class, a hash of the set, is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, to, ids, check in _sets(batch.column(1), k, apart):
                n = np.diff(to)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n), pa.array(ids, mask=n == 0), pa.array(check)], names=["_id", "n_shingles", "class", "check"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, class long, check long")


def _bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal values, with the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


_SEGMENT = "part long, classes binary, sizes binary, tokens binary, counts binary, common binary, seen binary, totals binary"
_NAMES = [f.split()[0] for f in _SEGMENT.split(", ")]


@dataclass
class Entries:
    """Shingles (tokens) of classes, a class and, once counted, a count each; common shingles; classes met for the first time (seen) and the sizes of their sets (totals)."""

    classes: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray
    common: np.ndarray
    seen: np.ndarray
    totals: np.ndarray

    @staticmethod
    def read(rows: pa.Table | pa.RecordBatch) -> Entries:
        get = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        return Entries(np.repeat(get("classes", np.int64), get("sizes", np.uint32)), get("tokens", np.uint64), get("counts", np.uint8), get("common", np.uint64), get("seen", np.int64), get("totals", np.uint32))

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(*[np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Entries)])

    def row(self, part: int) -> tuple:
        """A row with all of it; entries of a class that follow each other are one run."""
        at = _bounds(self.classes)
        return (part, self.classes[at[:-1]].tobytes(), np.diff(at).astype(np.uint32).tobytes(), *(x.tobytes() for x in (self.tokens, self.counts, self.common, self.seen, self.totals)))

    def cut(self, of_entries: np.ndarray, of_common: np.ndarray, of_seen: np.ndarray) -> list[tuple]:
        """A row for each part that has anything."""
        orders = [np.argsort(x, kind="stable") for x in (of_entries, of_common, of_seen)]
        parts = np.unique(np.concatenate([of_entries, of_common, of_seen]))
        (a, c, s), n = ([np.searchsorted(x[o], parts, side=side) for side in ("left", "right")] for x, o in zip((of_entries, of_common, of_seen), orders)), len(self.counts)
        e, m, f = orders
        classes, tokens, counts, common, seen, totals = self.classes[e], self.tokens[e], self.counts[e] if n else self.counts, self.common[m], self.seen[f], self.totals[f]
        return [Entries(classes[a0:a1], tokens[a0:a1], counts[a0:a1] if n else counts, common[c0:c1], seen[s0:s1], totals[s0:s1]).row(int(p)) for p, a0, a1, c0, c1, s0, s1 in zip(parts, *a, *c, *s)]


def _batch(rows: list[tuple], kind: type = pa.RecordBatch):
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return kind.from_arrays([pa.array(columns[0], pa.int64())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=_NAMES)


def _fragment(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _bucket(classes: np.ndarray, parts: int) -> np.ndarray:
    return (classes.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def _steps(parts: int) -> list[int]:
    """How many parts one part of each step holds, so that none is cut into more than FAN_OUT; the last is 1."""
    steps = [-(-parts // FAN_OUT)]
    while steps[-1] > 1:
        steps.append(-(-steps[-1] // FAN_OUT))
    return steps


def _by_token(e: Entries, parts: int, step: int) -> list[tuple]:
    return e.cut(_fragment(e.tokens, parts) // step, _fragment(e.common, parts) // step, _bucket(e.seen, parts) // step)


def _by_class(e: Entries, parts: int, step: int) -> list[tuple]:
    return e.cut(_bucket(e.classes, parts) // step, np.zeros(0, np.int64), _bucket(e.seen, parts) // step)


def _dealt(rows: DataFrame, parts: int, cut) -> DataFrame:
    """Rows cut by the first of the steps cut on to the last, and grouped by part; a part below 0 is final.

    A coarse part is dealt over as many tasks as it has parts, and each task gathers FRAGMENT_TOKENS before it cuts, so tasks and the rows they write are bounded.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * parts)
    steps = _steps(parts)
    for before, step in zip(steps, steps[1:]):

        def recut(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            held: list[Entries] = []
            for batch in batches:
                for row in range(batch.num_rows):
                    one = batch.slice(row, 1)
                    if one.column(0)[0].as_py() < 0:
                        yield one
                        continue
                    held.append(Entries.read(one))
                    if sum(len(e.tokens) for e in held) >= FRAGMENT_TOKENS:
                        yield _batch(cut(Entries.joined(held), parts, step))
                        held = []
            if held:
                yield _batch(cut(Entries.joined(held), parts, step))

        salt = F.pmod(F.xxhash64(F.octet_length("tokens"), F.substring("tokens", 1, 8)), F.lit(before))
        rows = rows.withColumn("_salt", salt).repartition(tasks, "part", "_salt").drop("_salt").mapInArrow(recut, _SEGMENT)
    return rows.repartition(tasks, "part")


def _segments(docs: DataFrame, id_col: str, text_col: str, k: int, fragments: int, apart: frozenset[int]) -> DataFrame:
    """Every set, cut into segments by ranges of the hash.

    common: shingles of a fragment known to be in many documents of one chunk. Their entries go, under
    parts below 0, past the count to the documents' buckets, so that no fragment gathers a shingle's whole
    posting list.
    """
    step = _steps(fragments)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        turn = 0
        for batch in batches:
            for _, _, flat, to, ids, _ in _sets(batch.column(1), k, apart):
                size = np.diff(to)
                fresh = np.zeros(len(ids), bool)
                for i, c in enumerate(ids.tolist()):
                    if size[i] and c not in met:
                        met.add(c)
                        fresh[i] = True
                keep = np.repeat(fresh, size)
                tokens, owner = flat[keep], np.repeat(ids, size)[keep]
                ordered = np.sort(tokens)
                often = np.unique(ordered[COMMON - 1 :][ordered[COMMON - 1 :] == ordered[: len(ordered) - COMMON + 1]]) if len(ordered) >= COMMON else ordered[:0]
                rows = []
                none = np.zeros(0, np.uint8)
                if len(often):
                    held = np.isin(tokens, often)
                    turn += 1
                    rows.append(Entries(owner[held], tokens[held], none, often[:0], ids[:0], size[:0]).row(-1 - (turn * 7919 + int(often[0] & np.uint64(0xFFFF))) % fragments))
                    tokens, owner = tokens[~held], owner[~held]
                rows += _by_token(Entries(owner, tokens, none, often, ids[fresh], size[fresh].astype(np.uint32)), fragments, step)
                yield _batch(rows)

    return docs.select(id_col, text_col).mapInArrow(run, _SEGMENT)


def _count_fragment(buckets: int, step: int):
    """The part of a fragment: entries of shingles in two or more sets, with the clipped count, dealt to buckets of classes."""

    def run(table: pa.Table) -> pa.Table:
        e = Entries.read(table)
        tokens, classes = e.tokens, e.classes
        if table.column("part")[0].as_py() < 0:
            counts = np.full(len(tokens), 255, np.uint8)
        else:
            order = np.argsort(tokens)
            tokens, classes = tokens[order], classes[order]
            at = _bounds(tokens)
            often = np.unique(e.common)
            known = np.isin(tokens[at[:-1]], often)
            keep = np.repeat((np.diff(at) > 1) | known, np.diff(at))
            tokens, classes = tokens[keep], classes[keep]
            order = np.lexsort((classes, tokens))
            tokens, classes = tokens[order], classes[order]
            single = np.ones(len(tokens), bool)  # a class that several tasks sent counts once
            single[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
            tokens, classes = tokens[single], classes[single]
            at = _bounds(tokens)
            n = np.minimum(np.diff(at), COMMON)
            n[np.isin(tokens[at[:-1]], often)] = 255
            n[n >= COMMON] = 255
            counts = np.repeat(n, np.diff(at)).astype(np.uint8)
            tokens, classes, counts = tokens[counts > 1], classes[counts > 1], counts[counts > 1]
        order = np.argsort(classes, kind="stable")
        return _batch(_by_class(Entries(classes[order], tokens[order], counts[order], e.common[:0], e.seen, e.totals), buckets, step), pa.Table)

    return run


_CANDIDATE = "class long, n long, tokens binary, prefix array<long>"


def _order_bucket(table: pa.Table) -> pa.Table:
    """Of a bucket's classes those that can have a link: size of the set, shared shingles in the global order, and the prefix."""
    e = Entries.read(table)
    classes, tokens, counts = e.classes, e.tokens, e.counts
    seen, first = np.unique(e.seen, return_index=True)
    totals = e.totals[first].astype(np.int64)
    order = np.lexsort((tokens, counts, classes))
    tokens, classes = tokens[order], classes[order]
    single = np.ones(len(tokens), bool)
    single[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
    tokens, classes = tokens[single], classes[single]
    at = _bounds(classes)
    names, shared = classes[at[:-1]], np.diff(at)
    total = totals[np.searchsorted(seen, names)] if len(names) else shared
    need = -(-3 * total // 4)
    lead = total - need + 1 - (total - shared)
    out = [(int(names[i]), int(total[i]), tokens[at[i] : at[i + 1]].tobytes(), tokens[at[i] : at[i] + lead[i]].view(np.int64)) for i in np.flatnonzero(shared >= need)]
    columns = list(zip(*out)) if out else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["class", "n", "tokens", "prefix"])


def _links(sizes: np.ndarray, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets with 100 * overlap >= 75 * union, from partial overlaps summed over fragments of the order."""
    m = len(sizes)
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(m), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = _bounds(flat)
    df = np.diff(at)
    total = np.zeros((m, m), np.int32)
    for d in np.unique(df[(df > 1) & (df <= 8)]):  # rare shingles: the few pairs of each
        group = owner[at[:-1][df == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i):
                pair, n = np.unique(group[:, j] * m + group[:, i], return_counts=True)
                total.ravel()[pair] += n.astype(np.int32)
    frequent = np.flatnonzero(df > 8)
    for low in range(0, len(frequent), COLUMNS):  # others: a fragment's incidence table times itself
        cut = frequent[low : low + COLUMNS]
        table = np.zeros((m, len(cut)), np.float32)
        table[owner[np.repeat(at[cut], df[cut]) + arrays.runs(df[cut])], np.repeat(np.arange(len(cut)), df[cut])] = 1
        for row in range(0, m, ROWS):
            total[row : row + ROWS] += (table[row : row + ROWS] @ table.T).astype(np.int32)
    found = []
    for row in range(0, m, ROWS):
        i, j = np.nonzero(7 * total[row : row + ROWS] >= 3 * (sizes[row : row + ROWS, None] + sizes[None, :]))
        found.append((i[j > i + row] + row, j[j > i + row]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _forest(classes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (class, smallest class of its component) for the components of links i-j."""
    label = np.arange(len(classes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(classes)))
    return classes[other], classes[label[other]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block; rows come sorted by block, and one block is held at a time."""
    key, held = None, []

    def emit() -> pa.RecordBatch:
        classes, sizes, tokens = (list(x) for x in zip(*held))
        i, j = _links(np.array(sizes, np.int64), [np.frombuffer(t, np.uint64) for t in tokens])
        a, b = _forest(np.array(classes, np.int64), i, j)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for group, block, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, block) != key:
                if len(held) > 1:
                    yield emit()
                key, held = (group, block), []
            held.append(row)
    if len(held) > 1:
        yield emit()


def candidates(docs: DataFrame, id_col: str, text_col: str, k: int, parts: int, apart: frozenset[int] = frozenset()) -> DataFrame:
    """Classes that can have a link: (class, n, tokens in the global order, prefix)."""
    fragments = _dealt(_segments(docs, id_col, text_col, k, parts, apart), parts, _by_token)
    shared = fragments.groupBy("part").applyInArrow(_count_fragment(parts, _steps(parts)[0]), _SEGMENT)
    return _dealt(shared, parts, _by_class).groupBy("part").applyInArrow(_order_bucket, _CANDIDATE)


def _blocks(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, block, class): the blocks that each class is compared in.

    A group of at most BLOCK classes and BLOCK_TOKENS shingles is one block. A larger one is cut by the size of the sets, each range 1.4
    times the one before, as linked sets differ by 4/3 at most; and each range into parts by a hash, of about so many
    classes and shingles at most. Any two parts of one range or of neighbouring ones meet in a block.
    """
    sized = groups.join(found.select(F.col("class").alias("node"), "n"), "node")
    if sized.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter((F.col("c") > BLOCK) | (F.col("s") > BLOCK_TOKENS)).isEmpty():
        return groups.select("component", F.col("node").alias("class"), F.lit(0).alias("block"))
    size = F.floor(F.log("n") / F.log(F.lit(1.4))).cast("int")
    rows = sized.select("node", "component", "n", F.struct("component", size.alias("size")).alias("range"))

    def neighbours(facts: DataFrame) -> DataFrame:
        of = facts.select("range.component", "range.size", "_n", "_s", F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_s") / BLOCK_TOKENS)).cast("int").alias("parts"))
        near = lambda step, name: of.select("component", (F.col("size") + step).alias("size"), F.col("parts").alias(name))
        whole = of.groupBy("component").agg(((F.sum("_n") > BLOCK) | (F.sum("_s") > BLOCK_TOKENS)).alias("large"))
        every = of.join(whole, "component").join(near(1, "below"), ["component", "size"], "left").join(near(-1, "above"), ["component", "size"], "left")
        return every.select(F.struct("component", "size").alias("range"), "parts", "large", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("above", F.lit(0)).alias("above"))

    placed = attach(rows, "range", "node", {"_n": F.count(F.lit(1)), "_s": F.sum("n")}, {"_n": F.sum("_n"), "_s": F.sum("_s")}, neighbours).withColumn("at", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("size", F.col("range.size"))
    name = lambda low, i, high, j: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    s, at, none = F.col("size"), F.col("at"), F.lit(-1)
    own = F.transform(F.filter(upto(F.col("parts")), lambda x: (x != at) | (F.col("parts") == 1)), lambda x: name(s, F.least(x, at), s, F.greatest(x, at)))
    up, down = F.transform(upto(F.col("above")), lambda x: name(s, at, s + 1, x)), F.transform(upto(F.col("below")), lambda x: name(s - 1, x, s, at))
    return placed.select("component", F.col("node").alias("class"), F.explode(F.when(F.col("large"), F.concat(own, up, down)).otherwise(F.array(name(none, none, none, none)))).alias("block"))


def class_links(found: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) between classes whose components are those of all links."""
    prefix = found.select(F.explode("prefix").alias("token"), "class")
    chains = attach(prefix, "token", "class", {"hub": F.min("class")}, {"hub": F.min("hub")}).filter("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
    groups = connected_components(chains)
    rows = found.select("class", "n", "tokens").join(_blocks(found, groups), "class").select("component", "block", "class", "n", "tokens")
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    return rows.repartition(tasks, "component", "block").sortWithinPartitions("component", "block").mapInArrow(_verify, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.75 or more of their k-word shingle sets.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text with fewer than k words has its whole
    sequence as its one shingle; one without words (or null) has an empty set and is linked with nothing.
    Returns a row per input row: the id, n_shingles (size of the set) and component_id (smallest id
    reachable by links, itself included; a null id comes after all others). Repeated rows stay
    repeated; other columns are left out; an empty table gives an empty table.

    Sets are compared by 64-bit hashes of their shingles. Equal sets are a class by 128 bits: classes are
    named by 64 of them, and where sets of one name differ in the others (searched for over all rows), they
    are named by those instead.
    """
    apart: frozenset[int] = frozenset()
    while True:
        sig = materialise(signatures(docs, id_col, text_col, k, apart), "jaccard-signatures")
        by_class = sig.groupBy("class").agg(F.sum("n_shingles").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        total, mixed = by_class.agg(F.sum("n"), F.collect_list(F.when(F.col("low") < F.col("high"), F.col("class")))).first()  # two sets in 10^10 share 64 bits
        if not mixed:
            break
        apart |= frozenset(mixed)
    parts = max(1, -(-(total or 0) // FRAGMENT_TOKENS))
    found = materialise(candidates(docs, id_col, text_col, k, parts, apart), "jaccard-candidates")
    roots = connected_components(class_links(found, parts))

    def per_class(low: DataFrame) -> DataFrame:
        rooted = low.join(roots, F.col("class") == F.col("node"), "left").withColumn("_root", F.coalesce("component", "class"))
        return attach(rooted, "_root", "class", {"_l": F.min("_low")}, {"component_id": F.min("_l")}).select("class", "component_id")

    out = attach(sig, "class", "_id", {"_low": F.min("_id")}, {"_low": F.min("_low")}, per_class)
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"))
