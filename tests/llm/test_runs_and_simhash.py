"""Periodic runs and SimHash components against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from tracewell.llm import periodic_runs, queries, simhash_join

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=24, times=3):
    """Every period in turn: stretches of equal words, each under its smallest period."""
    out, met = [], set()
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p) and (i, j + p - i) not in met:
                met.add((i, j + p - i))
                out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("probes, chunk", [(1 << 20, 64), (40, 2)])
def test_runs_equal_brute_force(monkeypatch, probes, chunk):
    monkeypatch.setattr(periodic_runs, "PROBES", probes)
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    rng = random.Random(5)
    found = 0
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 6)):
                unit = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 9))]
                words += (unit * rng.randint(1, 12))[: rng.randint(1, 80)] if rng.random() < 0.6 else [rng.randint(0, 40) for _ in range(rng.randint(0, 30))]
            docs.append(words)
        least, times = rng.choice([(24, 3), (4, 2), (6, 3), (1, 3)])
        got = periodic_runs.find_runs(np.array(sum(docs, []), np.int32), np.cumsum([0, *map(len, docs)]), least, times)
        assert got == [slow_runs(w, least, times) for w in docs]
        found += sum(map(len, got))
    assert found > 500


def test_runs_of_texts(spark):
    rows = [(1, "a b " * 12 + "c"), (2, "x\t" * 23), (3, "x\n" * 24), (4, None), (5, ""), (6, "A a " * 20), (6, "A a " * 20), (None, "q " * 30), (7, "p q r " * 7 + "p q " + "p q r " * 9)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = {(r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic_runs.periodic_runs(df).collect()}
    last = ("p q r " * 7 + "p q " + "p q r " * 9).split()
    kept = np.ones(len(last), bool)
    for s, n, p in slow_runs(last):
        kept[s + p : s + n] = False
    assert got == {(1, ((0, 24, 2),), "a b c"), (2, (), " ".join("x" * 23)), (3, ((0, 24, 1),), "x"), (4, (), ""), (5, (), ""), (6, ((0, 40, 2),), "A a"), (None, ((0, 30, 1),), "q"), (7, tuple(slow_runs(last)), " ".join(w for w, k in zip(last, kept) if k))}


def test_periodic_runs_query(spark, small):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = SPACES.findall(d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((d.doc_id, len(runs), *best, milli, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, small).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 3


@pytest.mark.parametrize("name", ["op1_warc", "op7_jaccard_join", "op12_periodic_runs"])
def test_queries_equal_sql(spark, small, same, name):
    same(queries.queries()[name](spark, small), queries.oracle_sql()[name])


def slow_components(rows, radius=2):
    """The smallest id reachable over fingerprints within the radius, by comparing all of them."""
    codes = sorted({c for _, c in rows})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, c in rows:
        if d is not None:
            least[find(c)] = min(least.get(find(c), d), d)
    return sorted(((d, c, least.get(find(c))) for d, c in rows), key=repr)


def slow_fingerprint(text):
    words = SPACES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_gray_rank_is_the_place_in_gray_order():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash_join.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("group, visitors, frontier", [(16384, 1 << 20, 1 << 19), (40, 25, 64)])
def test_components_of_codes_equal_brute_force(spark, monkeypatch, group, visitors, frontier):
    """Random codes, their neighbours, and a ball of codes around one of them that many ranges meet in."""
    for name, value in (("GROUP", group), ("VISITORS", visitors), ("FRONTIER", frontier)):
        monkeypatch.setattr(simhash_join, name, value)
    rng = random.Random(2)
    codes = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(3):
        codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) for c in codes[:150]]
    codes += [codes[0] ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i)] + [0, 0, 1, 2**64 - 1, 2**63]
    rows = list(enumerate(codes))
    signed = lambda c: c - (c >> 63 << 64)
    edges = simhash_join.links(spark.createDataFrame([(signed(c),) for c in codes], "code long"))
    from tracewell.operators.components import connected_components

    label = {r.node: r.component for r in connected_components(edges).collect()}
    groups = {}
    for d, c in rows:
        groups.setdefault(label.get(signed(c), signed(c)), []).append(d)
    got = sorted((d, codes[d], min(g)) for g in groups.values() for d in g)
    assert sorted(got, key=repr) == slow_components(rows)


def test_simhash_query(spark, small):
    rows = [(d.doc_id, slow_fingerprint(d.text)) for d in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op13_simhash_dedup(spark, small).collect()]
    assert sorted(got, key=repr) == slow_components(rows)


def test_simhash_of_odd_texts(spark):
    rows = [(5, None), (2, "  "), (3, "one"), (None, "ONE"), (9, "one two"), (4, "one two three"), (8, "ONE two\tthree"), (8, "ONE two\tthree"), (None, "alone here and nowhere else")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, code int")
    got = sorted(((r.doc_id, r.code % 2**64, r.component_id) for r in simhash_join.simhash_components(df).collect()), key=repr)
    assert got == slow_components([(d, slow_fingerprint(t)) for d, t in rows])
