"""Token counts that follow edits: a segment tree over pre-tokens, of which an edit touches a few leaves.

`count_leaves` encodes texts once and gives a table of each document's leaves. `apply_edits` reads such a
table, changes the documents that have edits, and gives the table that the next batch of edits reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import arrays
from tracewell.llm.bpe import CACHE_ENTRIES, Codec, codec
from tracewell.llm.pretokens import pretoken_starts, pretoken_starts_of
from tracewell.session import materialise

#: Code points before an edit that can change a boundary, and code points that a boundary looks ahead.
CONTEXT = 4
#: Documents whose trees are in memory at a time.
ROWS = 256


class CountedText:
    """A text, its pre-tokens as leaves, and a tree of sums of their code points and tokens.

    A leaf is a pre-token of the original text until an edit changes it; then it holds the new
    pre-tokens of the region (parts), and other leaves of the region are empty. The tree's shape stays; what is kept
    for later edits has every pre-token as a leaf again.
    """

    def __init__(self, text: str, starts: np.ndarray, tokens: np.ndarray, count):
        """starts: code point at which each pre-token starts; tokens: tokens of each; count: tokens of a pre-token."""
        self.pretokens = len(starts)
        if not self.pretokens:  # an empty text has one empty leaf, for what edits put in
            starts, tokens = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.text, self.starts, self.count = text, starts, count
        self.leaves = len(starts)
        self.cap = 1 << max(0, self.leaves - 1).bit_length()
        self.edited: dict[int, str] = {}
        self.parts: dict[int, tuple[list[int], list[int]]] = {}
        self.reencoded = 0
        self.length, self.tokens = np.zeros(2 * self.cap, np.int64), np.zeros(2 * self.cap, np.int64)
        self.length[self.cap : self.cap + self.leaves] = np.diff(starts, append=len(text))
        self.tokens[self.cap : self.cap + self.leaves] = tokens
        low = self.cap
        while low > 1:
            for tree in (self.length, self.tokens):
                tree[low // 2 : low] = tree[low : 2 * low : 2] + tree[low + 1 : 2 * low : 2]
            low //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def __len__(self) -> int:
        return int(self.length[1])

    def _leaf(self, position: int) -> tuple[int, int]:
        """The leaf with the code point at position, and where the leaf starts; past the end, the number of leaves."""
        if position >= self.length[1]:
            return self.leaves, int(self.length[1])
        node, start = 1, 0
        while node < self.cap:
            node *= 2
            if position - start >= self.length[node]:
                start += int(self.length[node])
                node += 1
        return node - self.cap, start

    def _content(self, leaf: int) -> str:
        if leaf in self.edited:
            return self.edited[leaf]
        start = self.starts[leaf]
        return self.text[start : start + self.length[self.cap + leaf]]

    def content(self) -> str:
        return "".join(map(self._content, range(self.leaves)))

    def _set(self, leaf: int, content: str, tokens: int) -> None:
        self.edited[leaf] = content
        node = self.cap + leaf
        more, longer = tokens - int(self.tokens[node]), len(content) - int(self.length[node])
        while node:
            self.tokens[node] += more
            self.length[node] += longer
            node //= 2

    def edit(self, position: int, removed: int, inserted: str) -> None:
        """Takes out removed code points at position and puts inserted there; what lies past the end is ignored."""
        position = max(0, min(position, len(self)))
        removed = max(0, min(removed, len(self) - position))
        if not removed and not inserted:
            return
        first, start = self._leaf(max(0, position - CONTEXT))
        if first == self.leaves:  # the place is the end of a text that is empty
            first, start = self.leaves - 1, len(self) - int(self.length[self.cap + self.leaves - 1])
        stop, at = self._leaf(position + removed)
        stop, step = min(self.leaves, max(first + 1, stop + (at < position + removed))), 1
        while True:
            region = "".join(map(self._content, range(first, stop)))
            region = region[: position - start] + inserted + region[position - start + removed :]
            ahead, after = "", stop
            while after < self.leaves and len(ahead) < CONTEXT:
                ahead += self._content(after)
                after += 1
            starts = pretoken_starts_of(region + ahead)
            if stop == self.leaves or len(region) in starts:
                break  # the old boundary is one of the new text too, so all that follows is as before
            stop, step = min(self.leaves, stop + step), 2 * step
        bounds = [x for x in starts if x < len(region)] + [len(region)]
        tokens = [self.count(region[a:b]) for a, b in zip(bounds, bounds[1:])]
        self.reencoded += len(bounds) - 1
        for leaf in range(first + 1, stop):
            self.parts.pop(leaf, None)
            if self.length[self.cap + leaf]:
                self._set(leaf, "", 0)
        self._set(first, region, sum(tokens))
        self.parts[first] = ([b - a for a, b in zip(bounds, bounds[1:])], tokens)

    def leaves_now(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points and tokens of each pre-token of the text as it is now."""
        out, last = [], 0
        for leaf in [*sorted(self.parts), self.leaves]:
            at = slice(self.cap + last, self.cap + leaf)
            full = self.length[at] > 0
            out.append((self.length[at][full], self.tokens[at][full]))
            if leaf < self.leaves:
                out.append(tuple(np.array(x, np.int64) for x in self.parts[leaf]))
            last = leaf + 1
        return tuple(np.concatenate(x) for x in zip(*out))


def _counter(c: Codec):
    """Tokens of a pre-token, each counted once."""
    size: dict[str, int] = {}

    def count(piece: str) -> int:
        if len(size) > CACHE_ENTRIES:
            size.clear()
        if piece not in size:
            size[piece] = len(c.merge(piece))
        return size[piece]

    return count


def _leaves(data: np.ndarray, offsets: np.ndarray, c: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and tokens of the pre-tokens of the documents with these byte offsets (from 0), all counted in one pass; offsets of the documents."""
    cp, at = arrays.code_points(data)
    edges = np.searchsorted(at, offsets)
    starts = pretoken_starts(cp, edges[:-1][edges[:-1] < edges[1:]])
    number = c.numbers(data, np.append(at[starts], len(data)).astype(np.int64), True)
    return np.diff(starts, append=len(cp)), c.cache.size[number], np.searchsorted(starts, edges)


def counted_texts(data: np.ndarray, offsets: np.ndarray, c: Codec) -> Iterator[CountedText]:
    """The documents with these byte offsets (from 0) in data."""
    (lengths, tokens, to), raw, count = _leaves(data, offsets, c), data.tobytes(), _counter(c)
    for d in range(len(offsets) - 1):
        n = lengths[to[d] : to[d + 1]]
        yield CountedText(raw[offsets[d] : offsets[d + 1]].decode("utf-8", "replace"), np.cumsum(n) - n, tokens[to[d] : to[d + 1]], count)


def packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after a byte that says how many."""
    size = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64) if raw else np.zeros(0, np.int64)


def count_leaves(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per input row: the id, the columns keep, text, and its leaves: lengths (code points) and tokens of its pre-tokens, in order, as packed bytes.

    A null text is empty and has no leaves. Repeated rows stay repeated; other columns are left out.
    """
    columns = [id_col, *keep]
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.BinaryType()) for n in ("lengths", "tokens")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(len(columns)))
            for low, high in arrays.chunks(offsets):
                lengths, tokens, to = _leaves(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], c)
                made = [pa.array([packed(x[a:b]) for a, b in zip(to, to[1:])], pa.binary()) for x in (lengths, tokens)]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)], "text", "lengths", "tokens")


def apply_edits(leaves: DataFrame, vocabulary: str, id_col: str = "doc_id", edits_col: str = "edits", keep: bool = True) -> DataFrame:
    """Documents after their edits, from a table of leaves with a column of edits.

    edits: array<struct<position, removed, inserted>>, applied in turn, positions in code points of the
    text as edited so far; null edits, null members and places past the end change nothing. Of a document
    without edits nothing is encoded or changed; of others only the regions of edits and some context.
    Returns the id, n_tokens, n_tokens_after, n_pretokens (leaves before), n_reencoded (pre-tokens that
    edits had encoded anew), and text, lengths and tokens, the leaves for the next batch, each a pre-token
    of the text as it is then, unless keep is false. Repeated rows stay repeated; other columns are left out.
    """
    rows = leaves.select(F.col(id_col).alias("_id"), "text", "lengths", "tokens", F.col(edits_col).alias("_edits"))
    counts = ("n_tokens", "n_tokens_after", "n_pretokens", "n_reencoded")
    schema = T.StructType([rows.schema["_id"], *[T.StructField(n, T.LongType()) for n in counts], *[rows.schema[n] for n in ("text", "lengths", "tokens")]])

    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(codec(vocabulary))
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                ids, texts, lengths, tokens, edits = batch.slice(low, ROWS).columns
                out: list[tuple] = []
                for text, raw, held, changes in zip(texts.to_pylist(), lengths.to_pylist(), tokens.to_pylist(), edits.to_pylist()):
                    own = unpacked(held)
                    before = int(own.sum())
                    changes = [e for e in changes or () if e is not None and e["position"] is not None]
                    if not changes:
                        out.append((before, before, len(own), 0, text or "", raw, held))
                        continue
                    n = unpacked(raw)
                    tree = CountedText(text or "", np.cumsum(n) - n, own, count)
                    for e in changes:
                        tree.edit(e["position"], e["removed"] or 0, e["inserted"] or "")
                    now = (tree.content(), *map(packed, tree.leaves_now())) if keep else (None, None, None)
                    out.append((before, tree.n_tokens, len(own), tree.reencoded, *now))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def count_edited(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts of every whole text before and after its edits: id, n_tokens, n_tokens_after, n_pretokens, n_reencoded.

    The leaves of all texts are written to the shared folder; the edits (as apply_edits takes them) are
    applied to what is read from there. A null text is empty. Repeated rows stay repeated; other columns are left out.
    """
    leaves = materialise(count_leaves(docs, vocabulary, id_col, text_col, (edits_col,)), "edit-leaves")
    return apply_edits(leaves, vocabulary, id_col, edits_col, keep=False)
