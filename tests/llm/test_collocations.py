"""Collocations against a plain count of all word sequences, and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import collocations, queries


def slow_collocations(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [q for q, b in counts.items() if b >= least and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("keys, dictionary", [(1 << 20, 1_000_000), (300, 1_000_000), (300, 2)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, keys, dictionary):
    monkeypatch.setattr(collocations, "KEYS", keys)
    monkeypatch.setattr(collocations, "DICTIONARY_WORDS", dictionary)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2000)
    rng = random.Random(4)
    words = ["the", "THE", "a", "é", "\x01x", "zz", "b", "b~", "中", " ", "x y", "word", "longer", "q1", "q2"]
    rows = [("en", None), (None, ""), (None, "a b c"), ("en", "  \t "), ("", "a a a. a a"), ("hot", "new york " * 1500), ("hot", "new\nyork\x0bnew york")]
    for _ in range(150):
        text = ""
        for _ in range(rng.randrange(30)):
            text += rng.choice(words) + rng.choice([" ", " ", "\t", "  ", " zz b~ ", ". ", ",", "\n", " a \x0c", ";the a é "])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    rows += rows[:30] + [("hot", "long text here, " * 20_000)]
    df = spark.createDataFrame([(1, lang, t, 2, "x") for lang, t in rows], "n long, lang string, text string, part int, word string").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=4, top=15).collect())
    want = slow_collocations(rows, 4, 15)
    assert got == want
    assert len(want) > 40


def test_counts_past_64_bits(spark):
    """2000000 * a is past 64 bits here."""
    a = 2**45
    words = spark.createDataFrame([("en", "x", a, 1), ("en", "y", a + 3, 2)], "lang string, word string, n long, id long")
    row = collocations._scored(spark.createDataFrame([((1 << 32) + 2, 0, a - 1)], "high long, low long, a long"), words).first()
    assert (row.l, row.r, row.score) == (a, a + 3, 2000000 * (a - 1) // (2 * a + 3))


def test_radix_sort():
    rng = np.random.default_rng(0)
    high, low = rng.integers(0, 2**63, 5000, dtype=np.uint64) >> np.uint64(40), rng.integers(0, 2**40, 5000, dtype=np.uint64)
    assert (collocations._sorted_keys(high, low) == np.lexsort((low, high))).all()


def test_empty_and_rare(spark):
    df = spark.createDataFrame([("en", "nothing often here")], "lang string, text string")
    assert collocations.collocations(df).count() == collocations.collocations(df.limit(0)).count() == 0


def test_collocations_query_equals_sql(spark, small, same):
    assert queries.op11_collocations(spark, small).count() > 5
    same(queries.op11_collocations(spark, small), queries.OP11_SQL)
