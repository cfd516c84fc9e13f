"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracewell.llm import arrays
from tracewell.llm.pretokens import classes
from tracewell.operators.blocks import numbered
from tracewell.session import materialise

SHINGLE = 5
SIMILARITY = 0.75
#: A fingerprint has BLOCKS blocks of WIDTH bits. Fingerprints within RADIUS bits agree to NEAR bits in one block at least, as RADIUS < BLOCKS * (NEAR + 1).
BLOCKS, WIDTH, NEAR = 7, 20, 4
#: A window of similarity 0.75 differs in about 17 of 100 bits (24 of 140, deviation 4.5), one that has nothing of the item in 70.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Items, and bytes of their texts, that one pass holds in memory; a larger benchmark takes several passes over the documents.
ITEMS, ITEM_BYTES = 1024, 32_000_000
#: Shingles, and windows, that are fingerprinted at a time.
STRETCH, WINDOWS = 1 << 14, 1 << 13


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of letters and digits, lower-cased) and the document of each."""
    cp, at = arrays.code_points(data)
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = classes()[cp] < 2
    edges = np.searchsorted(at, offsets)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = edges[:-1] < edges[1:]
    first, last = edges[:-1][full], edges[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    return arrays.range_hashes(_lower()[cp], a, b), np.searchsorted(edges, a, side="right") - 1


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, without regard to documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += words[j : j + n]
        acc ^= acc >> np.uint64(29)
    return arrays.mix(acc)


def _bit_sums(grams: np.ndarray) -> np.ndarray:
    """How many of the first n shingles have each bit of the fingerprint set, for n from 0 on."""
    per = 64 // WIDTH
    parts = []
    for b in range(BLOCKS):
        if b % per == 0:
            own = arrays.mix(grams ^ np.uint64((0x9E3779B97F4A7C15 * (b // per + 1)) & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(own, axis=1)
        parts.append(bits[:, (b % per) * WIDTH : (b % per + 1) * WIDTH])
    total = np.zeros((len(grams) + 1, BLOCKS * WIDTH), np.int32)
    np.cumsum(np.concatenate(parts, axis=1), axis=0, out=total[1:])
    return total


def simhash(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Blocks (int32) of the fingerprints of the windows of size shingles from each start on; a repeated shingle weighs as often as it occurs."""
    bits = 2 * (sums[starts + size] - sums[starts]) > size
    packed = np.packbits(bits.reshape(-1, BLOCKS, WIDTH), axis=2).astype(np.int32)
    shift = 8 * packed.shape[2] - WIDTH
    return sum(packed[:, :, i] << (8 * (packed.shape[2] - 1 - i)) for i in range(packed.shape[2])) >> shift


@lru_cache(maxsize=1)
def _neighbourhood() -> np.ndarray:
    """All values of a block with NEAR bits or fewer."""
    return np.array([sum(1 << i for i in c) for n in range(NEAR + 1) for c in combinations(range(WIDTH), n)], np.int32)


class Index:
    """Fingerprints of the items under every value of a block within NEAR bits of theirs, and their shingles for the exact comparison."""

    def __init__(self, texts: list[str | None]):
        data, offsets = arrays.string_buffers(pa.array(texts, pa.string()))
        words, owner = normal_words(data, offsets)
        own = [words[owner == i] for i in range(len(texts))]
        self.place = [i for i, w in enumerate(own) if len(w)]
        self.n_words = np.array([len(own[i]) for i in self.place], np.int64)
        self.k = np.minimum(self.n_words, SHINGLE)
        grams = [_grams(own[i], min(SHINGLE, len(own[i]))) for i in self.place]
        self.counts = [Counter(g.tolist()) for g in grams]
        self.prints = np.concatenate([simhash(_bit_sums(g), np.zeros(1, np.int64), len(g)) for g in grams] or [np.zeros((0, BLOCKS), np.int32)])
        self.known = {}
        for k in np.unique(self.k).tolist():
            hashes = np.unique(np.concatenate([grams[i] for i in np.flatnonzero(self.k == k)]))
            table = np.zeros(1 << 20, bool)
            table[(hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.known[k] = (hashes, table)
        self.tables = []
        for b in range(BLOCKS):
            near = (self.prints[:, b, None] ^ _neighbourhood()).ravel()
            order = np.argsort(near, kind="stable")
            at = np.zeros((1 << WIDTH) + 1, np.int32)
            np.cumsum(np.bincount(near, minlength=1 << WIDTH), out=at[1:])
            self.tables.append((at, (order // len(_neighbourhood())).astype(np.int16 if len(self.place) < 1 << 15 else np.int32)))

    def fetched(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) that share a block but for NEAR bits; those that share several come as often."""
        windows, items = [], []
        for b, (at, held) in enumerate(self.tables):
            low = at[prints[:, b]]
            n = at[prints[:, b] + 1] - low
            windows.append(np.repeat(np.arange(len(prints)), n))
            items.append(held[np.repeat(low, n) + arrays.runs(n)])
        return np.concatenate(windows), np.concatenate(items).astype(np.int64)

    def near(self, prints: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) of the items that fit within RADIUS bits: from the blocks, then by all bits."""
        w, i = self.fetched(prints)
        w, i = w[fits[i]], i[fits[i]]
        w, i = np.divmod(np.unique(w * len(self.place) + i), max(1, len(self.place)))
        close = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
        return w[close], i[close]

    def _stretches(self, words: np.ndarray, doc: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, int, int, int]]:
        """(shingles, first, start, stop): parts of the words in which some window holds a shingle of the benchmark.

        A window without any has similarity 0 with every item, so it is not fingerprinted; the test names no
        item. A part has STRETCH windows at most to start in it, and what they reach over.
        """
        hashes, table = self.known[k]
        grams = _grams(words, k)
        p = np.flatnonzero(table[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        p = p[hashes[np.minimum(np.searchsorted(hashes, grams[p]), len(hashes) - 1)] == grams[p]]
        p = p[doc[p] == doc[p + k - 1]]
        if not len(p):
            return
        reach = int(self.n_words[self.k == k].max())
        edge = np.searchsorted(doc, [doc[p], doc[p] + 1])  # of the documents
        low, high = np.maximum(edge[0], p - reach), np.minimum(edge[1], p + reach)
        cut = np.concatenate([[True], (low[1:] > high[:-1]) | (doc[p[1:]] != doc[p[:-1]])])
        for a, b in zip(low[cut].tolist(), np.append(high[:-1][cut[1:]], high[-1]).tolist()):
            for start in range(a, b, STRETCH):
                stop = min(b, start + STRETCH + reach)
                yield grams[start : stop - k + 1], start, min(b, start + STRETCH), stop

    def hits(self, words: np.ndarray, doc: np.ndarray, n_docs: int) -> dict[int, dict[int, tuple[float, int, int]]]:
        """By document and item: best similarity of SIMILARITY or more, first word and words of that window."""
        count = np.bincount(doc, minlength=n_docs)
        begin = np.cumsum(count) - count
        out: dict[int, dict[int, tuple[float, int, int]]] = {}
        for k in self.known:
            sizes = np.unique(self.n_words[self.k == k]).tolist()
            for grams, first, last, stop in self._stretches(words, doc, k):
                sums, d = _bit_sums(grams), int(doc[first])
                whole = int(count[d])
                for size in [*(s for s in sizes if s <= whole), *([whole] if k <= whole < sizes[-1] else [])]:
                    starts = np.arange(first, min(last, stop - size + 1)) - first
                    fits = (self.k == k) & ((self.n_words == size) | ((self.n_words > size) & (size == whole)))
                    found: dict[int, list[np.ndarray]] = {}
                    for at in range(0, len(starts), WINDOWS):
                        part = starts[at : at + WINDOWS]
                        w, i = self.near(simhash(sums, part, size - k + 1), fits)
                        for x in np.unique(i).tolist():
                            found.setdefault(x, []).append(part[w[i == x]])
                    for i, near in found.items():
                        best = self._best(grams, np.concatenate(near), i, size - k + 1, len(starts), out.get(d, {}).get(i), first - int(begin[d]), size)
                        if best:
                            out.setdefault(d, {})[i] = best
        return out

    def _best(self, grams: np.ndarray, near: np.ndarray, i: int, n: int, windows: int, best: tuple | None, offset: int, size: int) -> tuple | None:
        """The most similar window of n shingles that starts within n of one in near, the first of equals; best: the one known so far."""
        item, total = self.counts[i], sum(self.counts[i].values())
        mark = np.zeros(windows + 1, np.int64)
        np.add.at(mark, np.maximum(0, near - n), 1)
        np.add.at(mark, np.minimum(windows, near + n + 1), -1)
        starts = np.flatnonzero(np.cumsum(mark)[:windows] > 0)
        shared = np.concatenate([[0], np.cumsum(np.isin(grams, np.fromiter(item, np.uint64, len(item))))])
        most = np.minimum(shared[starts + n] - shared[starts], total)
        bound = most / (n + total - most)
        value, place = (best[0], best[1]) if best else (0.0, 0)
        found = best
        for j in np.lexsort((starts, -bound)).tolist():
            if bound[j] < max(SIMILARITY, value):
                break  # even with all of them counted it is not similar enough
            window = Counter(grams[starts[j] : starts[j] + n].tolist())
            both = sum(min(c, item[h]) for h, c in window.items() if h in item)
            v, at = both / (n + total - both), offset + int(starts[j])
            if v >= SIMILARITY and (v > value or (v == value and at < place)):
                value, place, found = v, at, (v, at, size)
        return found


_INDEXES: dict[str, Index] = {}


def _index(key: str, texts: list[str | None]) -> Index:
    """The index of a pass; a worker makes it once."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(texts)
    return _INDEXES[key]


@dataclass(frozen=True)
class Items:
    """The different texts of a benchmark, a pass at a time: ITEMS of them at most, and ITEM_BYTES of text, but for a single longer one.

    texts: (i, t), and p where there are several passes. ids: (no, id) of all rows where texts are repeated or there are several
    passes, and i is no then; else ids is null, and i the item's id.
    """

    passes: int
    texts: DataFrame
    ids: DataFrame | None

    def each(self) -> Iterator[tuple[list, list]]:
        """i and t of a pass; no more are on the driver at once."""
        for p in range(self.passes):
            rows = (self.texts.filter(F.col("p") == p) if self.passes > 1 else self.texts).collect()
            rows.sort(key=lambda r: (r.i is None, r.i if r.i is not None else 0, r.t or ""))
            if rows:
                yield [r.i for r in rows], [r.t for r in rows]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> Items:
    named = benchmark.select(F.col(item_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).filter("t <> ''")
    rows, kinds, longest = named.agg(F.count(F.lit(1)), F.count_distinct("t"), F.coalesce(F.max(F.octet_length("t")), F.lit(0))).first()
    held = max(1, min(ITEMS, ITEM_BYTES // max(1, longest)))
    passes = max(1, -(-kinds // held))
    if rows == kinds and passes == 1:
        return Items(1, named, None)
    different = numbered(named.select("t").distinct(), "t").select((F.col("place") - 1).alias("no"), "t")
    different = materialise(different.withColumn("p", F.floor(F.col("no") / held)), "benchmark-texts")
    return Items(passes, different.select(F.col("no").alias("i"), "t", "p"), materialise(named.join(different.select("no", "t"), "t").select("no", F.col("i").alias("id")), "benchmark-ids"))


def _find(docs: DataFrame, ids: list, texts: list, item_type: T.DataType, text_at: int, name: str, keep: str) -> DataFrame:
    """docs with the column name of hits; keep: rows with hits only, or without only."""
    parts = [("item_id", item_type), ("similarity", T.DoubleType()), ("start_word", T.LongType()), ("n_words", T.LongType())]
    hit = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in parts]))
    held, key, kind = docs.sparkSession.sparkContext.broadcast(texts), f"{id(texts)}-{len(texts)}-{hash(tuple(texts))}", to_arrow_type(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, held.value)
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(text_at))
            for low, high in arrays.chunks(offsets):
                base = offsets[low]
                words, doc = normal_words(data[base : offsets[high]], offsets[low : high + 1] - base)
                found = index.hits(words, doc, high - low) if len(words) else {}
                chosen = [d for d in range(high - low) if (d in found) == (keep == "hits")]
                part = batch.slice(low, high - low).take(pa.array(chosen, pa.int64()))
                hits = [[{"item_id": ids[index.place[i]], "similarity": v, "start_word": s, "n_words": n} for i, (v, s, n) in sorted(found.get(d, {}).items())] for d in chosen]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, kind)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, hit)]))


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Benchmark items found in documents: a row (id, item_id, similarity, start_word, n_words) per document and item.

    Words are runs of letters and digits, lower-cased, so case and punctuation do not hide a passage. A
    window has as many words as the item (the whole document where that is shorter); its similarity is
    the Jaccard similarity of the 5-word shingles, each weighing as often as it occurs, and counts from
    0.75 on. The best window is returned, the first of equals. Items without words are in nothing; null
    texts are empty; repeated rows of either table give repeated results (a text that many items have is searched for once); ids of any type, null too, are carried as they
    are; other columns are left out.

    Windows of each item size get a fingerprint, and the Hamming blocks alone say which items each is
    compared with: all fingerprints within RADIUS bits are found, then the windows around them are compared
    exactly. A window of similarity 0.75 lies beyond RADIUS about once in a hundred times, one of 0.8 once in
    ten thousand; several windows beside the best one count too. Where one shingle makes most of an item,
    fingerprints differ more. Windows without any shingle of the benchmark have similarity 0 and no fingerprint.
    """
    items = _items(benchmark, item_col, item_text_col)
    kind = benchmark.schema[item_col].dataType
    named, parts = docs.select(id_col, text_col), []
    for ids, texts in items.each():
        found = _find(named, ids, texts, kind if items.ids is None else T.LongType(), 1, "_hits", "hits").select(id_col, F.explode("_hits").alias("_hit")).select(id_col, "_hit.*")
        parts.append(materialise(found, "contaminations") if items.passes > 1 else found)
    none = lambda kind: F.lit(None).cast(kind)
    if not parts:
        return docs.limit(0).select(id_col, none(kind).alias("item_id"), none("double").alias("similarity"), none("long").alias("start_word"), none("long").alias("n_words"))
    out = reduce(DataFrame.unionByName, parts)
    if items.ids is None:
        return out
    ids = items.ids.select(F.col("no").alias("_no"), F.col("id").alias("_item"))
    return out.withColumnRenamed("item_id", "_no").join(ids, "_no").select(id_col, F.col("_item").alias("item_id"), "similarity", "start_word", "n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, in whose text contaminations finds no item."""
    name = "_hits"
    while name in docs.columns:
        name += "_"
    items = _items(benchmark, item_col, item_text_col)
    for ids, texts in items.each():
        docs = _find(docs, ids, texts, benchmark.schema[item_col].dataType if items.ids is None else T.LongType(), docs.columns.index(text_col), name, "clean").drop(name)
        docs = materialise(docs, "uncontaminated") if items.passes > 1 else docs
    return docs
