"""Secret scans: fixed formats, and random strings told by how few characters a token of theirs has."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm import arrays
from tracewell.llm.bpe import codec

KINDS = ("assign", "access", "hex", "random")
# The formats searched for.
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_ASSIGN_MIN, _ACCESS_MIN, _HEX_MIN = 12, 18, 16
#: A random string has so many characters at least; what lies between its joints has so few a token at most.
RANDOM_MIN, RANDOM_RATIO = 20, 2.2
#: Lengths of the hexadecimal digests in use (MD5, SHA-1, SHA-2 and SHA-3 families).
_DIGESTS = {32, 40, 56, 64, 96, 128}
_HEXADECIMAL = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_LETTER = re.compile(rb"[A-Za-z]")
#: Characters that join the words of paths, queries and names, and begin or end the parts of a run.
_JOINT = re.compile(rb"[/_=+-]+")
#: It has a part of so many characters between joints at least, and as a whole so few a token.
PART_MIN, PART_RATIO = 8, 2.0
#: A random string has so many different characters at least; one letter over and over, or four of them, make no secret.
_KINDS_MIN = 7
#: How images, documents and archives begin in base64.
_MEDIA = (b"iVBORw0KGgo", b"/9j/", b"R0lGOD", b"JVBERi0", b"UEsDB", b"H4sIA")
#: Words, short numbers, and parts of the alphabet, which are no words and not random either.
_ALPHABET = rb"(?:" + rb"|".join(bytes(range(i, 123))[:n] for i in range(97, 120) for n in range(123 - i, 3, -1)) + rb")"
_PIECE = re.compile(rb"(?i:" + _ALPHABET + rb")|[A-Z]?[a-z]+?(?=" + _ALPHABET + rb"|[^a-z]|$)|[A-Z]+|[0-9]{1,4}")
_IN_ORDER = re.compile(_ALPHABET)

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_RUN = np.zeros(256, bool)
_IS_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def _runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of members of at least so many bytes."""
    edge = np.diff(member.astype(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist()))


def _leftmost(text: bytes, pattern: re.Pattern, at: list[int]) -> Iterator[re.Match]:
    """Non-overlapping matches, which can begin only at the places at."""
    last = 0
    for i in sorted(at):
        if i >= last and (m := pattern.match(text, i)):
            last = m.end()
            yield m


def _places(text: bytes, word: bytes) -> list[int]:
    out, i = [], text.find(word)
    while i >= 0:
        out.append(i)
        i = text.find(word, i + 1)
    return out


def is_known(run: bytes, tokens_of) -> bool:
    """Digests of the usual lengths, UUIDs, runs without a letter (long numbers are of kind hex), and identifiers: the words of such a run, in lower case, its short numbers and parts of the alphabet have RANDOM_RATIO characters a token."""
    if not _LETTER.search(run) or _UUID.fullmatch(run) or len(run) in _DIGESTS and _HEXADECIMAL.fullmatch(run):
        return True
    pieces = _PIECE.findall(run)
    return sum(map(len, pieces)) >= RANDOM_RATIO * sum(1 if p.isdigit() or _IN_ORDER.fullmatch(p.lower()) else tokens_of(p.lower()) for p in pieces)


def is_random(run: bytes, tokens_of) -> bool:
    """Under RANDOM_RATIO characters a token, and nothing known."""
    return len(run) < RANDOM_RATIO * tokens_of(run) and len(set(run)) >= _KINDS_MIN and not run.startswith(_MEDIA) and not is_known(run, tokens_of)


def random_parts(run: bytes, tokens_of) -> list[tuple[int, int]]:
    """Spans of the random strings in a run.

    Parts between joints that have under RANDOM_RATIO characters a token and are no words go together with their
    neighbours of the same kind; together they count from RANDOM_MIN characters on, with one part of PART_MIN and under
    PART_RATIO characters a token in all. So a key is found at the end of a path, in a query or behind a name, and one with joints of its own is one span.
    """
    if run.startswith(_MEDIA):
        return []
    out, begin, end, longest = [], None, 0, 0
    joints = [(m.start(), m.end()) for m in _JOINT.finditer(run)]
    for a, b in zip([0, *(e for _, e in joints)], [*(s for s, _ in joints), len(run)]):
        part = run[a:b]
        like = bool(part) and len(part) < RANDOM_RATIO * tokens_of(part) and not (len(part) > 3 and is_known(part, tokens_of))
        if like:
            begin, end, longest = (a if begin is None else begin), b, max(longest, b - a)
        if begin is not None and (not like or b == len(run)):
            whole = run[begin:end]
            if len(whole) >= RANDOM_MIN and longest >= PART_MIN and len(whole) < PART_RATIO * tokens_of(whole) and is_random(whole, tokens_of):
                out.append((begin, end))
            begin, longest = None, 0
    return out


def scan(text: bytes, ends: list[int], tokens_of) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) in bytes of the texts that end at ends, each followed by a line feed, in text."""
    spans: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    flat = np.frombuffer(text, np.uint8)
    lower = text.lower()
    found = [(m.start(), 0, m.end()) for m in _leftmost(text, _ASSIGN, [i for w in _KEYWORDS for i in _places(lower, w)]) if len(m[1]) >= _ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in _leftmost(text, _ACCESS, _places(text, b"AKIA")) if m.end() - m.start() >= _ACCESS_MIN]
    found += [(a, 2, b) for a, b in _runs(_IS_HEX[flat], _HEX_MIN)]
    for a, b in _runs(_IS_RUN[flat], RANDOM_MIN):
        found += [(a + i, 3, a + j) for i, j in random_parts(text[a:b], tokens_of)]
    for span in sorted(found):
        spans[bisect_right(ends, span[0])].append(span)
    return spans


def find_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text; a row per input row: the id and spans, an array of (kind, start, end).

    assign, access and hex are fixed formats. random is what lies in a run of [A-Za-z0-9+/_=-] between two of [/_=+-] or
    an end, neighbours together, each with under 2.2 characters a token under the tiktoken vocabulary in the file vocabulary, of 20
    characters or more and under 2 a token in all, one part of 8 at least. It is no digest of a usual length, UUID, string without a letter or of under 7
    different characters, beginning of an image or archive, and no identifier: its words in lower case and short numbers
    have 2.2 characters a token or more. Shorter strings are not looked for. Positions are code
    points, ends exclusive; spans are ordered by start, then kind. A null text has no spans; repeated
    rows stay repeated; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = codec(vocabulary).split_and_merge
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(1))
            for low, high in arrays.chunks(offsets):
                raw = data[offsets[low] : offsets[high]].tobytes()
                at = (offsets[low : high + 1] - offsets[low]).tolist()
                text = b"".join(raw[a:b] + b"\n" for a, b in zip(at, at[1:]))
                ends = [b + i for i, b in enumerate(at[1:])]
                out = []
                for i, found in enumerate(scan(text, ends, lambda run: len(merge(run.decode("ascii"))))):
                    places, last, points = {}, at[i] + i, 0
                    for x in sorted({x for a, _, b in found for x in (a, b)}):  # each part of the text is decoded once
                        points += len(text[last:x].decode("utf-8", "replace"))
                        places[x], last = points, x
                    out.append([{"kind": KINDS[k], "start": places[a], "end": places[b]} for a, k, b in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(out, spans_type)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: long, end: long>>")
