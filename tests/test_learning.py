"""Greedy acceptance, bridges and replay against plain versions."""

import random
import re
from collections import Counter

import pytest

from tracewell.operators import greedy, linker, replay


def slow_accept(pairs, most, per_end):
    taken, used = [], Counter()
    for a, b, s in sorted(set(pairs), key=lambda p: (-p[2], p[0], p[1])):
        if used[a] < per_end and used[b] < per_end and len(taken) < most:
            used.update((a, b))
            taken.append((a, b, s))
    return sorted(taken)


@pytest.mark.parametrize("nodes, n, most, per_end, first", [(12, 150, 1000, 3, 8), (60, 900, 20, 2, 1), (60, 900, 45, 1, 1), (400, 900, 1000, 5, 8)])
def test_greedy_equals_one_pass(spark, monkeypatch, nodes, n, most, per_end, first):
    """Few similarities, so ties abound; one end has a third of all pairs."""
    monkeypatch.setattr(greedy, "FIRST", first)
    rng = random.Random(nodes + n)
    pairs = []
    while len(pairs) < n:
        a, b = (0 if rng.random() < 0.33 else rng.randrange(nodes)), rng.randrange(nodes)
        if a != b:
            pairs.append((f"n{a}", f"n{b}", rng.randrange(5) / 5))
    df = spark.createDataFrame(pairs, "a string, b string, similarity double").repartition(4)
    assert sorted(map(tuple, greedy.accept(df, most, per_end).collect())) == slow_accept(pairs, most, per_end)
    assert greedy.accept(df.limit(0), most, per_end).count() == 0


def slow_links(rows):
    words = lambda t: {w for w in re.split(r"[^\w\-.]+", (t or "").lower()) if len(w.encode()) >= 4}
    out = []
    for i in rows:
        for j in rows:
            if i["at"] is None or j["at"] is None or i["at"] >= j["at"] or i["t"] == j["f"]:
                continue
            gap = j["at"] - i["at"]
            near = 0.8 if gap < 60 else 0.6 if gap < 300 else 0.4 if gap < 600 else 0.3 if gap < 3600 else 0.15
            shared = len(words(i["o"]) & words(j["d"]))
            bad = any(w in (i["o"] or "").lower() for w in ("error", "failed", "panic", "denied", "not found", "fatal"))
            c = near * 0.65 if bad and shared >= 2 and near >= 0.4 else near * 0.55 if shared >= 3 and near >= 0.4 else 0
            if c >= 0.3:
                out.append((i, j, c))
    return out


@pytest.mark.parametrize("cell", [2000, 3])
def test_bridges_equal_comparing_all(spark, monkeypatch, cell):
    monkeypatch.setattr(linker, "CELL_ROWS", cell)
    rng = random.Random(1)
    words = ["parser.rs", "build", "cache-key", "abc", "server", "login", "deploy", "naïve", "failed", "denied", "timeout", "common"]
    say = lambda: " ".join(["common"] * (rng.random() < 0.7) + rng.sample(words, rng.randint(0, 6)))
    rows = [{"id": rng.randrange(10**6), "f": f"n{rng.randrange(25)}", "t": f"n{rng.randrange(25)}", "d": say(), "o": say(), "at": rng.choice([None, *[rng.randrange(2000) for _ in range(8)]])} for _ in range(160)]
    rows += [{"id": 10**6 + k, "f": "x", "t": "y", "d": "Permission denied parser.rs", "o": "permission DENIED parser.rs", "at": 50 + k // 2} for k in range(4)]
    df = spark.createDataFrame([(r["id"], r["f"], r["t"], r["d"], r["o"], r["at"]) for r in rows], "id long, from_id string, to_id string, decision string, outcome string, event_time long")
    want = slow_links(rows)
    got = sorted((r.a, r.b, round(r.confidence, 6)) for r in linker.links(df).collect())
    assert got == sorted((i["id"], j["id"], round(c, 6)) for i, j, c in want) and len(got) > 100
    known = {(r["f"], r["t"]) for r in rows[::3]}
    bridges = {}
    for i, j, c in sorted(want, key=lambda x: (x[0]["at"], x[0]["id"], x[1]["at"], x[1]["id"])):
        bridges.setdefault((i["t"], j["f"]), round(c, 6))
    edges = spark.createDataFrame(sorted(known), "from_id string, to_id string")
    made = linker.bridges(df, edges, 7)
    assert {(r.from_id, r.to_id): round(r.confidence, 6) for r in made.collect()} == {k: c for k, c in bridges.items() if k not in known}
    assert linker.bridges(df, edges.unionByName(made.select("from_id", "to_id")), 8).count() == 0


def test_words_of_the_linker(spark):
    rows = [(2, "permission denied on config.toml", "edit", 0, "a", "b"), (1, "x", "fix permission of config.toml", 5, "c", "d"), (3, "timeout reaching config.toml permission", "edit", 20, "e", "f"), (4, "x", "again permission config.toml", 25, "g", "h"), (5, "q", "see permission of config.toml", 0, "i", "j")]
    df = spark.createDataFrame(rows, "id long, outcome string, decision string, event_time long, from_id string, to_id string")
    # a refusal is a failure, a timeout is none; equal times link nothing; ids have no say
    assert {(r.a, r.b): round(r.confidence, 4) for r in linker.links(df).collect()} == {(2, 1): 0.52, (2, 4): 0.52}


def slow_replay(edges, nodes, starts, now, steps):
    edges = {i: [s, d, rel, w, v] for i, s, d, rel, w, v in edges}
    count, last, log = {n: c for n, c, _ in nodes}, {n: t for n, _, t in nodes}, []
    for _, seed in sorted(starts):
        chain = [seed]
        for _ in range(steps):
            following = [e[1] for i, e in sorted(edges.items()) if e[0] == chain[-1] and e[4] and e[2] == "caused"]
            if not following or following[0] in chain:
                break
            chain.append(following[0])
        if len(chain) < 2:
            continue
        for a, b in zip(chain, chain[1:]):
            i = next(i for i, e in sorted(edges.items()) if (e[0], e[1]) == (a, b))
            old, edges[i][3] = edges[i][3], min(2.0, edges[i][3] * 1.05)
            log.append(("ltp", i, a, old, edges[i][3]))
        for n in chain:
            count[n] = count.get(n, 0) + 1
            log.append(("replay", None, n, count[n] - 1.0, float(count[n])))
    for i, e in sorted(edges.items()):
        if e[4]:
            old, e[3] = e[3], e[3] * (1 - 0.01 * (0.5 if count.get(e[0], 0) > 3 else 1))
            log.append(("ltd", i, e[0], old, e[3]))
    for i, e in sorted(edges.items()):
        if e[4] and abs(e[3]) < 0.05 and count.get(e[0], 0) == 0 and (now is None or now - last.get(e[0], -(10**12)) > 30 * 86400):
            e[4] = False
            log.append(("gc", i, e[0], e[3], 0.0))
    return edges, count, log


@pytest.mark.parametrize("now", [10**9, None])
def test_replay_and_its_log(spark, monkeypatch, now):
    monkeypatch.setattr(replay, "WALKS", 4)
    rng = random.Random(6)
    edges = [(i, f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice(["caused", "caused", "enabled"]), rng.choice([0.01, 0.04, 0.5, 1.0, 1.99, 2.5]), rng.random() < 0.85) for i in range(60)]
    nodes = [(f"n{k}", rng.choice([0, 0, 0, 3]), 10**9 - 86400 * 5 * k) for k in range(20)]
    starts = [(w, f"n{rng.choice([0, 1, 2, 2, 2, 19])}") for w in range(20)]
    frame = spark.createDataFrame(edges, "id long, src string, dst string, relation string, weight double, valid boolean")
    graph, new_nodes, log = replay.consolidate(frame, spark.createDataFrame(nodes, "node string, replay_count long, last_activated long"), spark.createDataFrame(starts, "walk long, node string"), now, 4)
    want, count, entries = slow_replay(edges, nodes, starts, now, 4)
    assert {r.id: (round(r.weight, 9), r.valid) for r in graph.collect()} == {i: (round(e[3], 9), e[4]) for i, e in want.items()}
    assert {r.node: r.replay_count for r in new_nodes.collect()} == {n: count[n] for n, _, _ in nodes}
    got = [(r.op, r.id, r.node, round(r.old_value, 9), round(r.new_value, 9)) for r in log.orderBy("seq").collect()]
    assert got == [(op, i, n, round(a, 9), round(b, 9)) for op, i, n, a, b in entries]
    again = replay.apply_log(frame, log)
    key = lambda df: sorted((r.id, round(r.weight, 9), r.valid) for r in df.collect())
    assert key(again) == key(graph)
    assert any(op == "gc" for op, *_ in entries) and max(Counter(i for op, i, *_ in entries if op == "ltp").values()) > 4


def test_replay_without_walks(spark):
    frame = spark.createDataFrame([(1, "a", "b", "caused", 0.5, True), (2, "a", "c", "enabled", 0.04, True)], "id long, src string, dst string, relation string, weight double, valid boolean")
    none = spark.createDataFrame([], "walk long, node string")
    graph, _, log = replay.consolidate(frame, spark.createDataFrame([("a", 0, 0)], "node string, replay_count long, last_activated long"), none)
    assert {r.id: (round(r.weight, 6), r.valid) for r in graph.collect()} == {1: (0.495, True), 2: (0.0396, False)}
    assert [r.op for r in log.orderBy("seq").collect()] == ["ltd", "ltd", "gc"]


def test_links_of_entries_whose_ids_repeat(spark):
    rows = [(1, "n1", "n2", "start cache server", "cache server failed", 100), (1, "n3", "n4", "restart cache server", "index done", 130), (1, "n5", "n6", "rebuild search index", "search index failed", 150), (1, "n7", "n8", "rebuild search index", "none", 190)]
    df = spark.createDataFrame(rows, "id long, from_id string, to_id string, decision string, outcome string, event_time long")
    assert sorted((r.na, r.nb, round(r.confidence, 4)) for r in linker.links(df).collect()) == [("n2", "n3", 0.52), ("n6", "n7", 0.52)]
    made = linker.bridges(df, spark.createDataFrame([], "from_id string, to_id string"), 7)
    assert sorted((r.from_id, r.to_id) for r in made.collect()) == [("n2", "n3"), ("n6", "n7")]
