"""Byte-level BPE: vectorised pre-tokens, cached pair merges, offsets for decoding.

`encode` and `decode` are the operators; `Codec` does the work on a batch and runs on the executors.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tracewell.llm import arrays
from tracewell.llm.pretokens import pretoken_starts

#: Distinct pre-tokens that a worker keeps; beyond it the cache starts afresh, which only costs time.
CACHE_ENTRIES = 400_000
#: Pre-tokens of more bytes are merged anew each time, to bound the cache's memory.
CACHE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass
class Encoded:
    """Tokens of a range of documents, laid end to end."""

    ids: np.ndarray  #: uint32
    doc_tokens: np.ndarray  #: offsets of the documents in ids
    pieces: np.ndarray  #: byte offsets of pre-tokens in the range's text, with the end
    piece_tokens: np.ndarray  #: offsets of the pre-tokens in ids
    doc_pieces: np.ndarray  #: offsets of the documents among the pre-tokens


class _Cache(dict):
    """Number of each known pre-token; an unknown one is merged and numbered. Numbers index growing arrays."""

    def __init__(self, merge: Callable[[str], list[int]]):
        super().__init__()
        self.merge, self.new_ids, self.new_sizes, self.count = merge, [], [], 0
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: bytes) -> int:
        ids = self.merge(piece.decode("utf-8", "replace"))
        self.new_ids += ids
        self.new_sizes.append(len(ids))
        number, self.count = self.count, self.count + 1
        if len(piece) <= CACHE_BYTES:
            self[piece] = number
        return number

    def settle(self) -> None:
        """Moves what has been merged since the last call to the arrays."""
        if self.new_sizes:
            size = np.array(self.new_sizes, np.int64)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.array(self.new_ids, np.uint32)])
            self.new_ids, self.new_sizes = [], []


def _gather(flat: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Slices of flat that start at at, laid end to end with the offsets to."""
    index = np.repeat((at - to[:-1]).astype(np.int32), np.diff(to))
    index += np.arange(to[-1], dtype=np.int32)
    return np.take(flat, index)


class Codec:
    """Encodes and decodes batches with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        whole = tiktoken.Encoding("pair-merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.merge = whole.encode_ordinary  # of one pre-token: joins the adjacent pair of lowest rank until none is left
        self.split_and_merge = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache = _Cache(self.merge)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def numbers(self, data: np.ndarray, edges: np.ndarray, exact: bool) -> np.ndarray:
        """Cache number of each pre-token between edges; unless exact, equal 64-bit hashes stand for equal bytes."""
        if len(self.cache) > CACHE_ENTRIES or len(self.cache.flat) > 8 * CACHE_ENTRIES:
            self.cache = _Cache(self.merge)
        raw, a, b = data.tobytes(), edges[:-1], edges[1:]
        if not exact:
            key = arrays.word_hashes(data, a, b, lower=False)
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            a, b = a[order[new]], b[order[new]]
        number = np.fromiter(map(self.cache.__getitem__, [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]), np.int64, len(a))
        self.cache.settle()
        if not exact:
            every = np.empty(len(order), np.int64)
            every[order] = number[np.cumsum(new) - 1]
            return every
        return number

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Encoded, np.ndarray, np.ndarray]:
        """Tokens of documents with these byte offsets (n + 1, from 0) in data; then what decode makes of the ids.

        The decoded bytes are compared with data: were two pre-tokens of one hash mixed up, all are looked up by their bytes.
        """
        cp, at = arrays.code_points(data)
        first = np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])
        pieces = np.append(at[pretoken_starts(cp, first)], len(data)).astype(np.int64)
        for exact in (False, True):
            number = self.numbers(data, pieces, exact)
            piece_tokens = np.concatenate([[0], np.cumsum(self.cache.size[number])])
            ids = _gather(self.cache.flat, self.cache.at[number], piece_tokens)
            content, ends = self.decode(ids)
            if np.array_equal(content, data):
                break
        doc_pieces = np.searchsorted(pieces, offsets)
        return Encoded(ids, piece_tokens[doc_pieces], pieces, piece_tokens, doc_pieces), content, ends

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the byte offset of each id with the end."""
        at = np.concatenate([[0], np.cumsum(self.token_len[ids])])
        return _gather(self.token_bytes, self.token_at[ids], at), at


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text (null: as empty) with the ranks in the file vocabulary.

    Returns a row per input row: the id, n_tokens, ids (array<int>), piece_ends (array<int>: byte offset
    at which each pre-token ends) and piece_tokens (array<int>: tokens of each pre-token). Any slice of
    pre-tokens can thus be decoded alone. An empty text has empty arrays; repeated rows stay repeated;
    other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(1))
            for low, high in arrays.chunks(offsets):
                base = offsets[low]
                e, _, _ = c.encode(data[base : offsets[high]], offsets[low : high + 1] - base)
                ends = e.pieces[1:] - np.repeat(offsets[low:high] - base, np.diff(e.doc_pieces))
                lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(e.doc_tokens)), lists(e.doc_tokens, e.ids.astype(np.int32)), lists(e.doc_pieces, ends), lists(e.doc_pieces, np.diff(e.piece_tokens))],
                    names=[id_col, "n_tokens", "ids", "piece_ends", "piece_tokens"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, piece_ends array<int>, piece_tokens array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of every row's ids: the id and content (binary). A null list gives empty bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            out = []
            for ids in lists:
                part = np.array(ids.values.to_numpy() if ids.is_valid else [], np.int64)
                out.append(c.decode(part)[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "content"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, content binary")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids, and digests both without moving them through the JVM.

    Returns the id, n_tokens (long), ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (decoded bytes), both lower-case hex. A null text counts as empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(1))
            for low, high in arrays.chunks(offsets):
                base = offsets[low]
                e, content, at = c.encode(data[base : offsets[high]], offsets[low : high + 1] - base)
                raw, text = e.ids.astype("<u4").tobytes(), content.tobytes()
                tokens = e.doc_tokens.tolist()
                ends = at[e.doc_tokens].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(np.diff(e.doc_tokens)),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(tokens, tokens[1:])], pa.string()),
                        pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
