"""Arrow string columns as flat numpy arrays: bytes, code points, words, word hashes and shingles.

Every kernel takes whole texts of many documents laid end to end plus their offsets, so the cost per
document is a few vector operations and no Python loop runs over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of vector operations takes (a longer document is a pass of its own).
CHUNK_BYTES = 800_000

_MULT = 0x9E3779B97F4A7C15
_U64 = np.uint64


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about size bytes each; every document is in exactly one range."""
    n, low = len(offsets) - 1, 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of UTF-8 bytes and the byte position of each."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if data.max() < 0x80:
        return data.astype(np.uint32), np.arange(len(data), dtype=np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.uint32)
    high = np.flatnonzero(cp >= 0xC0)
    if len(high):
        lead, pos = cp[high], at[high]

        def follow(k: int) -> np.ndarray:
            return data[np.minimum(pos + k, len(data) - 1)].astype(np.uint32) & 0x3F

        two = ((lead & 0x1F) << 6) | follow(1)
        wide = np.where(lead >= 0xE0, ((lead & 0x0F) << 12) | (follow(1) << 6) | follow(2), two)
        cp[high] = np.where(lead >= 0xF0, ((lead & 0x07) << 18) | (follow(1) << 12) | (follow(2) << 6) | follow(3), wide)
    return cp, at


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; x is changed in place and returned."""
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, as far as n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])) for base in (_MULT, _INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each document, or runs of bytes that gaps (by byte) has as false: byte starts, byte ends, and the document of each."""
    gap = (_SPACE if gaps is None else gaps)[data]
    open_ = ~gap
    starts = open_.copy()
    starts[1:] &= gap[:-1]
    ends = open_
    ends[:-1] &= gap[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = ~gap[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = ~gap[last]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, np.searchsorted(offsets, a, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


def joined_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words with one space after each; of each word its start and end there, and its document."""
    a, b, doc = words(data, offsets)
    ends = np.cumsum(b - a + 1) - 1
    out, keep = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8), np.ones(int(ends[-1]) + 1 if len(ends) else 0, bool)
    keep[ends] = False
    letters = data[~_SPACE[data]]
    out[keep] = _LOWER[letters] if lower else letters
    return out, ends - (b - a), ends, doc


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of values, from one running polynomial over all of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    terms = values.astype(np.uint64)
    terms += _U64(1)
    terms *= power[: len(values)]
    np.cumsum(terms, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range (A-Z lower-cased)."""
    return range_hashes(_LOWER[data] if lower else data, starts, ends)


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, the document of each, and the index of its first word.

    A document with 1 to k - 1 words has its whole sequence as its one shingle.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    at = np.arange(len(doc), dtype=np.int64)
    short = count < k
    whole = at + k <= (first + count)[doc]
    out = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - k + 1
    if n > 0:
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc *= _U64(_MULT)
            acc += hashes[j : j + n]
            acc ^= acc >> _U64(29)
        out[:n] = acc
    keep = whole
    few = np.flatnonzero(short & (count > 0))
    if len(few):
        keep = whole.copy()
        for d in few:
            acc = 0
            for h in hashes[first[d] : first[d] + count[d]].tolist():
                acc = (acc * _MULT + h) & 0xFFFFFFFFFFFFFFFF
                acc ^= acc >> 29
            out[first[d]] = (acc + int(count[d])) & 0xFFFFFFFFFFFFFFFF
            keep[first[d]] = True
    index = np.flatnonzero(keep)
    return mix(out[index]), doc[index], index


def distinct_per_doc(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, laid end to end, and offsets (n_docs + 1)."""
    out, sizes = np.empty_like(values), np.zeros(n_docs + 1, np.int64)
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    at = to = 0
    for d, n in enumerate(count.tolist()):
        if n:
            part = np.sort(values[at : at + n])
            if n > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            out[to : to + len(part)] = part
            to += len(part)
            at += n
        sizes[d + 1] = to
    return out[:to], sizes


def distinct_ranges(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of byte ranges that lie end to end, equal for equal bytes, and the distinct ranges in the order of their numbers."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def runs(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of lengths, laid end to end."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def take(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of these columns, cast to the schema."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(i).type) for i, x in enumerate(columns[n] for n in schema.names)], schema=schema)
