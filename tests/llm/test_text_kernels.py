"""Kernels, tokenizer and edits against the tokenizer library and plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tracewell.llm import arrays, bpe, edit_counts, pretokens

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["'", "s", "t", "re", "ve", "ll", "'s", " ", "  ", "\n", "\t", "\r\n", "a", "word", "é", "中", "1", "²", "!", "?", "\u00a0", "\u2003", "👍", "\u0301"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def encode(codec, docs):
    data, offsets = arrays.string_buffers(pa.array(docs, pa.string()))
    e, content, _ = codec.encode(data, offsets)
    assert content.tobytes() == data.tobytes()
    return e, [e.ids[a:b].tolist() for a, b in zip(e.doc_tokens, e.doc_tokens[1:])]


def test_ids_equal_the_library(codec, library):
    docs = [*texts(5000, 1), None, "", "x" * 9000, "ab" * 4000 + " " * 500, "don't 'S it'll we've"]
    assert encode(codec, docs)[1] == [library.encode_ordinary(d or "") for d in docs]


def test_every_code_point_class(codec, library):
    docs = [f"a{chr(c)}1{chr(c)}{chr(c)}! {chr(c)}" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    assert encode(codec, docs)[1] == [library.encode_ordinary(d) for d in docs]


def test_scan_equals_regex():
    import regex

    docs = [t for t in texts(3000, 2) if t]
    for t in docs:
        assert pretokens.pretoken_starts_of(t) == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)]
    cp = np.array([ord(c) for t in docs for c in t], np.uint32)
    first = np.cumsum([0, *map(len, docs[:-1])])
    want = [f + s for f, t in zip(first, docs) for s in pretokens.pretoken_starts_of(t)]
    assert pretokens.pretoken_starts(cp, first).tolist() == want


def test_slices_decode_alone(codec):
    e, _ = encode(codec, ["Hello wörld's end"])
    a, b = e.pieces[1], e.pieces[2]
    ids = e.ids[e.piece_tokens[1] : e.piece_tokens[2]]
    assert codec.decode(ids)[0].tobytes() == "Hello wörld's end".encode()[a:b]


def test_small_cache_gives_the_same(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    own = bpe.Codec(codec.ranks)
    for _ in range(3):
        docs = texts(200, 5)
        assert encode(own, docs)[1] == [library.encode_ordinary(d) for d in docs]


def test_edits_equal_a_full_count(codec, library):
    r = random.Random(3)
    for t in texts(400, 4):
        data, offsets = arrays.string_buffers(pa.array([t]))
        x, now = next(edit_counts.counted_texts(data, offsets, codec)), t
        assert x.n_tokens == len(library.encode_ordinary(t))
        for _ in range(5):
            p, n, new = r.randrange(0, len(now) + 2), r.randrange(0, 6), "".join(r.choice(PIECES) for _ in range(r.randrange(0, 3)))
            at = min(p, len(now))
            now = now[:at] + new + now[at + n :]
            x.edit(p, n, new)
            assert x.content() == now and x.n_tokens == len(library.encode_ordinary(now))


def test_an_edit_touches_little(codec):
    data, offsets = arrays.string_buffers(pa.array(["some words here " * 2000]))
    x = next(edit_counts.counted_texts(data, offsets, codec))
    x.edit(16000, 3, "XYZ")
    assert x.reencoded < 10


def test_words_and_shingles():
    docs = ["A b\x0bC d e f", "", " ", "one two", "ONE two"]
    data, offsets = arrays.string_buffers(pa.array(docs))
    a, b, doc = arrays.words(data, offsets)
    assert [data[i:j].tobytes().decode() for i, j in zip(a, b)] == [w for d in docs for w in re.findall(r"[^\x20\x09-\x0D]+", d)]
    tokens, owner, _ = arrays.shingle_hashes(arrays.word_hashes(data, a, b), doc, len(docs))
    assert np.bincount(owner, minlength=5).tolist() == [2, 0, 0, 1, 1] and tokens[2] == tokens[3]
    assert list(arrays.chunks(np.array([0, 5, 5, 100, 101]), 10)) == [(0, 2), (2, 3), (3, 4)]
