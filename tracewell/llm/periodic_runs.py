"""Maximal periodic runs of words by probing a harmonic grid.

A run of period p and at least 3p words covers several neighbouring multiples of p. So for every p word jp is
compared with word (j + 1)p, n/p probes and n log n in all. Where enough neighbouring probes hold, a few
more words between them are compared, and what survives is extended to both sides by comparing chunks. Periods go in
doubling ranges: a multiple of a period comes in a later range, where grid points inside a run that was found
already are skipped, so a run is found once, under its smallest period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm import arrays

#: Grid points probed at a time (one period of one document is not cut).
PROBES = 1 << 20
#: Words compared between the grid points of a candidate before it is extended.
CHECKS = 8
#: Words that the first chunk of an extension compares; each next one is twice as long.
CHUNK = 64


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of texts laid end to end, equal for equal words; the words with one space after each; start and end of each; offsets of the documents in words."""
    joined, a, b, doc = arrays.joined_words(data, offsets, lower=False)
    letters = joined[np.repeat(np.tile([True, False], len(a)), np.stack([b - a, np.ones_like(a)], 1).ravel())] if len(a) else joined
    at = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters))])
    ids = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(a) else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))]) if len(a) else np.zeros(len(offsets), np.int64)
    return ids, joined, a, b, first.astype(np.int64)


def _reach(equal_at: Callable[[int, int], np.ndarray], at: int, end: int, step: int) -> int:
    """How far from at towards end all words are equal, compared chunk by chunk."""
    size = CHUNK
    while at != end:
        size = min(size, abs(end - at))
        low, high = (at, at + size) if step > 0 else (at - size, at)
        bad = np.flatnonzero(~equal_at(low, high))
        if len(bad):
            return low + int(bad[0]) if step > 0 else low + int(bad[-1]) + 1
        at += step * size
        size *= 2
    return at


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """For each document (words first[d] to first[d + 1] of ids) its runs (start, length, period) by start, then period.

    A run is a stretch with smallest period p and at least max(least, times * p) words that no neighbouring word extends.
    """
    sizes = np.diff(first)
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    longest = np.where(sizes >= least, sizes // times, 0)
    low = 1
    while len(longest) and low <= longest.max():
        docs = np.flatnonzero(longest >= low)
        n_periods = np.minimum(longest[docs], 2 * low - 1) - low + 1
        owner, period = np.repeat(docs, n_periods), low + arrays.runs(n_periods)
        probes = (sizes[owner] - 1) // period
        ends = np.cumsum(probes)
        at = 0
        while at < len(owner):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PROBES, side="right")))
            _probe(ids, first, owner[at:upto], period[at:upto], probes[at:upto], found, least, times)
            at = upto
        low *= 2
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _probe(ids, first, owner, period, probes, found, least: int, times: int) -> None:
    """Adds the runs of these documents and periods, none of them a multiple of another."""
    start = np.cumsum(probes) - probes
    item = np.repeat(np.arange(len(owner)), probes)
    at = first[owner][item] + arrays.runs(probes) * period[item]
    same = ids[at] == ids[at + period[item]]
    _skip_found(same, owner, period, start, found)
    edge = np.zeros(len(same) + 1, bool)
    edge[start] = True
    begins = same & (edge[:-1] | ~np.concatenate([[False], same[:-1]]))
    stops = same & (np.concatenate([edge[1:-1], [True]]) | ~np.concatenate([same[1:], [False]]))
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    need = np.maximum(least, times * period[item[a]]) // period[item[a]] - 1
    wide = b - a >= need
    a, b, need = a[wide], b[wide], need[wide]
    anchor = np.repeat(a, b - a - need + 1) + arrays.runs(b - a - need + 1)
    span = (np.repeat(need, b - a - need + 1) - 1) * period[item[anchor]]
    for check in range(1, CHECKS):
        there = at[anchor] + 1 + check * (span - 1) // CHECKS
        good = (span < 2) | (ids[there] == ids[np.minimum(there + period[item[anchor]], len(ids) - 1)])
        anchor, span = anchor[good], span[good]
    done = -1
    last = None
    for k in range(len(anchor)):
        i = int(item[anchor[k]])
        d, p = int(owner[i]), int(period[i])
        base, top = int(first[d]), int(first[d + 1])
        here = int(at[anchor[k]])
        if (d, p) == last and here < done:
            continue
        equal = lambda x, y: ids[x:y] == ids[x + p : y + p]  # noqa: B023, E731
        right = _reach(equal, here, top - p, 1)
        last, done = (d, p), right
        left = _reach(equal, here, base, -1)
        length = right + p - left
        if length >= max(least, times * p) and not any(p % q == 0 and s <= left - base and left - base + length <= s + n for s, n, q in found[d]):
            found[d].append((left - base, length, p))


def _skip_found(same, owner, period, start, found) -> None:
    """Takes out the probes of which both words lie in a run whose period divides theirs."""
    at = 0
    while at < len(owner):
        d = int(owner[at])
        upto = at + int(np.searchsorted(owner[at:], d, side="right"))
        low, high = int(period[at]), int(period[upto - 1])
        for s, n, q in found[d]:
            for p in range(-(-low // q) * q, high + 1, q):
                i = int(start[at + p - low])
                same[i + -(-s // p) : i + max(0, (s + n - 1) // p)] = False
        at = upto


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: a word goes that a run has after its first period."""
    change = np.zeros(n + 1, np.int32)
    for s, length, p in runs:
        change[s + p] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) == 0


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, places: Callable | None = None) -> DataFrame:
    """The periodic runs of every text, and the text with each of them cut to its first period.

    Words are [^\\x20\\x09-\\x0D]+, compared exactly and numbered from 0. A run is a stretch of consecutive words
    with smallest period p (words p apart are equal) of max(least, times * p) words or more that no neighbouring
    word extends; a stretch of a smaller period's run counts there only. places(id, n), if given, names for a row with n words the original word that
    stands at each place, or is null.
    Returns a row per input row: the id, runs (by start, then period) and collapsed (the kept words joined by a
    space). Null, empty and blank texts have no words and no runs. Repeated rows and null ids stay; other
    columns are left out; an empty table gives an empty table. A text is worked on by one task, in memory in proportion to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(1))
            for i, j in arrays.chunks(offsets):
                ids, joined, a, b, first = word_ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys = batch.column(0).slice(i, j - i)
                order: dict[int, np.ndarray] = {}
                for d, key in enumerate(keys.to_pylist() if places else ()):
                    to = places(key, int(first[d + 1] - first[d]))
                    if to is not None:
                        order[d] = first[d] + to
                if order:
                    ids = ids.copy()
                    fresh = {d: ids[to] for d, to in order.items()}
                    for d, part in fresh.items():
                        ids[first[d] : first[d + 1]] = part
                found, texts, raw = find_runs(ids, first, least, times), [], joined.tobytes()
                for d, runs in enumerate(found):
                    low, high = int(first[d]), int(first[d + 1])
                    if not runs and d not in order:
                        texts.append(raw[a[low] : b[high - 1]] if high > low else b"")
                        continue
                    of = order.get(d, np.arange(low, high))[collapsed(high - low, runs)]
                    texts.append(b" ".join([raw[x:y] for x, y in zip(a[of].tolist(), b[of].tolist())]))
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
                yield pa.RecordBatch.from_arrays([keys, pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(texts, pa.binary()).cast(pa.string())], names=["_id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"_id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("_id", id_col)
