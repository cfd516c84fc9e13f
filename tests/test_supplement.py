"""Drained sessions, backfilled vectors, and what is added to results."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import backfill, drain, novelty
from tracewell.plans import supplement
from tracewell.plans.memory import Memory
from tracewell.sources.commits import Store

TURNS = "session_id long, turn_index long, speaker string, text string, event_time long, embedding array<float>, distilled_at long"


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return dot / size if size else 0.0


def slow_drain(sessions, least, limit):
    """One session at a time in order, each against all distilled before it."""
    done = {s: v for s, _, v, d in sessions if d and v}
    out, marks = {}, set()
    for s, _, v, d in sorted([x for x in sessions if not x[3]], key=lambda x: (x[1], x[0]))[:limit]:
        if v is None:
            out[s] = (True, None)
            marks.add(s)
            continue
        best = min(((-round(cosine(v, w), 6), p) for p, w in done.items() if cosine(v, w) >= least), default=None)
        out[s] = (best is not None, best and best[1])
        if best:
            done[s] = v
            marks |= {s, best[1]}
    return out, marks


@pytest.mark.parametrize("limit", [None, 25])
def test_drain_equals_one_session_at_a_time(spark, limit):
    rng = random.Random(7)
    sessions = [(s, rng.randrange(20), None if rng.random() < 0.15 else [float(rng.randrange(-3, 4)) for _ in range(4)], rng.random() < 0.1) for s in range(60)]
    rows = [(s, i, "user", f"turn {i} of {s}", at + i, v if i == 0 else None, 5 if d else None) for s, at, v, d in sessions for i in range(2)]
    marked, items, outcome = drain.drain(spark.createDataFrame(rows, TURNS), lambda said: said.orderBy("session_id", "place").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t")), 99, 0.8, limit)
    want, marks = slow_drain(sessions, 0.8, limit)
    assert {r.session_id: (r.distilled, r.prior) for r in outcome.collect()} == want
    assert {r.session_id for r in marked.filter("distilled_at = 99").collect()} == {s for s in marks if not sessions[s][3]}
    assert marked.filter("distilled_at = 5").count() == 2 * sum(d for *_, d in sessions)  # a mark is written once
    told = {r.session_id: [x.text for x in r.t] for r in items.collect()}
    assert told == {s: [f"turn {i} of {x}" for x in ([p] if p is not None else []) + [s] for i in range(2)] for s, (ok, p) in want.items() if ok}
    assert limit or any(p in want for ok, p in want.values() if ok)  # one of this batch was matched too
    again = drain.drain(marked, lambda said: said.limit(0), 100, 0.8)[2]
    assert not set(r.session_id for r in again.collect()) & {s for s, (ok, _) in want.items() if ok}


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    root, asked = f"file://{tmp_path}/v", []

    def embed(rows, broken=False):
        ids = [r.id for r in rows.orderBy("id").collect()]
        asked.append(ids)
        if broken and len(asked) == 2:
            raise RuntimeError("away")
        return rows.select("id", F.when(F.col("id") != 5, F.array(F.length("text").cast("float"))).alias("vector"))

    items = spark.createDataFrame([(i, "x" * i) for i in range(8)] + [(9, None), (3, "xxxx")], "id long, text string")
    with pytest.raises(RuntimeError):
        backfill.backfill(Store.open(spark, root), items, lambda r: embed(r, True), "m", 3)
    done = backfill.backfill(Store.open(spark, root), items, embed, "m", 3)
    assert asked == [[0, 1, 2], [3, 4, 5], [3, 4, 5], [5, 6, 7]]  # 5 fails twice
    assert sorted((r.id, r.vector[0]) for r in done.table("vectors").collect()) == [(i, float(i)) for i in range(8) if i != 5]
    backfill.backfill(Store.open(spark, root), items, embed, "m", 3)
    assert len(asked) == 4
    backfill.backfill(done, items.filter("id < 2"), embed, "other", 10)
    assert asked[4:] == [[0, 1]]
    edges = spark.createDataFrame([(7, "a", "b"), (4, "a", "c"), (6, "c", "a")], "id long, from_id string, to_id string")
    vectors = spark.createDataFrame([("a", "m", [1.0]), ("b", "m", [2.0]), ("c", "m", [3.0]), ("z", "m", [4.0])], "id string, model string, vector array<float>")
    assert sorted((r.edge_id, r.vector[0]) for r in backfill.edge_vectors(vectors, edges).collect()) == [(4, 1.0), (6, 3.0), (7, 2.0)]


def test_hybrid_novelty_asks_for_the_band_alone(spark):
    rows = spark.createDataFrame([(1, "d1", "a b c d"), (2, "d2", "a b c d"), (3, "d3", "a b c d"), (4, "d4", "a b c d")], "id long, decision string, text string")
    predicted = spark.createDataFrame([(1, "a b c d"), (2, "a b x y"), (3, "p q r s"), (4, "a b x y")], "id long, text string")
    asked = []

    def predict(r):
        asked.extend(sorted(x.id for x in r.collect()))
        return r.select("id", F.when(F.col("id") == 2, F.lit("a b c")).alias("text"))

    # 2 and 4 share 2 of 6 words: 0.667, in the band; 4 gets no answer
    verdicts, counts = novelty.hybrid(rows, predicted, predict)
    assert {r.id: (round(r.surprise, 3), r.novel, r.asked) for r in verdicts.collect()} == {1: (0.0, False, False), 2: (0.25, False, True), 3: (1.0, True, False), 4: (0.667, True, True)}
    assert asked == [2, 4] and tuple(counts.first()) == (4, 2, 1)


def test_two_lists_and_sessions(spark):
    lists = [spark.createDataFrame(x, "qid long, id string, rank long") for x in ([(1, "a", 1), (1, "b", 2), (2, "z", 1)], [(1, "c", 1), (1, "b", 2), (1, "d", 3), (3, "q", 1)])]
    got = {}
    for r in supplement.two_lists(*lists).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {1: ["a", "b", "c", "d"], 2: ["z"], 3: ["q"]}
    chunks = spark.createDataFrame([(f"u::s{s}::{n}", f"word{s} talk {n}") for s in range(3) for n in range(4)], "id string, text string")
    edges = spark.createDataFrame([(10, "u::s0::0", "u::s0::1"), (11, "u::s1::2", "u::s1::2"), (-3, "u::s2::0", "u::s2::0")], "id long, from_id string, to_id string")
    ranked = spark.createDataFrame([(1, "10", 1), (1, "11", 2), (1, "-3", 3), (2, "10", 1)], "qid long, id string, rank long")
    asked = spark.createDataFrame([(1, "word0 word1", True), (2, "word0", False)], "qid long, query string, aggregation boolean")
    out = supplement.with_sessions(ranked, edges, chunks, asked, slots=8, sessions=2)
    rows = sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[5]))
    assert [r for r in rows if not r[4]] == [(1, "10", None, None, False, 1), (1, "11", None, None, False, 2), (1, "-3", None, None, False, 3), (2, "10", None, None, False, 1)]
    made = [r for r in rows if r[4]]
    assert [(r[0], r[1], r[2], r[5]) for r in made] == [(1, None, f"1::session_expansion::{k}", 3 + k) for k in range(1, 6)]
    assert {r[3] for r in made} == {"word0 talk 2", "word0 talk 3", "word1 talk 0", "word1 talk 1", "word1 talk 3"}  # ends are not added again, the third session is not among the best


def test_seeded_boost_in_order_and_without_repeats(spark, monkeypatch):
    monkeypatch.setattr(supplement, "LINES", 4)
    monkeypatch.setattr(supplement, "PREFIX", 12)
    nodes = spark.createDataFrame([("n1", "rollercoaster at the park", 1.0, "q1"), ("n2", "tickets were cheap", 0.5, "q1"), ("n3", "TICKETS WERE dear in the end", 0.5, "q1"), ("n4", "the museum was shut", 0.5, "q1"), ("n5", "rollercoaster elsewhere", 1.0, "q2"), ("n6", "already shown line", 0.5, "q1"), ("n7", "a ride", 0.5, "q1"), ("n8", "Museum of ships", 0.5, "q1"), ("n9", "last of all lines", 0.5, "q1")], "id string, text string, q_value double, task_tag string")
    graph = spark.createDataFrame([("n1", "n2", "caused", 0.9, True), ("n2", "n3", "caused", 0.9, True), ("n1", "n6", "caused", 0.8, True), ("n4", "n7", "caused", 0.9, True), ("n8", "n9", "caused", 0.9, True)], "src string, dst string, relation string, weight double, valid boolean")
    asked = spark.createDataFrame([("q1", "q1", ["Rollercoaster", "at", "museum"]), ("q9", "q9", ["museum"])], "qid string, task_tag string, entities array<string>")
    shown = spark.createDataFrame([("q1", "- user: Already shown line, and more"), ("q2", "x")], "qid string, text string")
    got = [(r.qid, r.place, r.id) for r in supplement.seeded_boost(asked, nodes, graph, shown).orderBy("qid", "place").collect()]
    assert got == [("q1", 1, "n1"), ("q1", 2, "n2"), ("q1", 3, "n4"), ("q1", 4, "n8")]  # n3 repeats n2's beginning, n6 is shown, n5 is another question's; two letters spread nothing


def test_boosted_lines_asks_for_every_conversation(spark, tmp_path):
    from tracewell import catalogue

    rows = [(1, 0, "user", "the alphabet song"), (1, 1, "assistant", "sing it"), (6, 0, "user", "an Alphabet game"), (10, 0, "user", "of planets"), (3, 0, "user", "no name"), (16, 1, "user", "alphabet without a first turn")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.qid, r.id) for r in catalogue.queries()["boosted_lines"](spark, str(tmp_path)).collect())
    held = {1: ["c16::s0::1", "c1::s0::0", "c6::s0::0"], 6: ["c16::s0::1", "c1::s0::0", "c6::s0::0"], 10: ["c10::s0::0"]}
    assert set(got) >= {(q, i) for q, ids in held.items() for i in ids} and {q for q, _ in got} == {1, 6, 10}


def test_told_lesson(spark):
    chunks = spark.createDataFrame([("a", "deploy the cache", 1, 0.5), ("b", "it failed", 1, 0.5), ("c", "rolled back", 1, 0.5)], "id string, text string, created_at long, q_value double")
    edges = spark.createDataFrame([(1, "a", "b", "caused", 0.9, 5, None, "t", None), (2, "b", "c", "caused", 0.8, 6, None, "t", None)], "id long, from_id string, to_id string, relation string, confidence double, event_time long, valid_to long, task_tag string, outcome_polarity string")
    none = spark.createDataFrame([], "id long, key string, value string, scope string, updated_at long, valid_to long")
    vectors = spark.createDataFrame([(2, [1.0, 0.0])], "id long, vector array<float>")
    memory = Memory(chunks, edges, none, none, vectors)
    says = {0: "keep the cache", 1: "alpha beta", 2: "alpha gamma", 3: None}
    seen = []

    def tell(asked):
        seen.extend((r.sample, r.stubs.count("\n") + 1, r.temperature) for r in asked.collect())
        return spark.createDataFrame([(k, v) for k, v in says.items()], "sample long, text string").join(asked.select("sample"), "sample")

    r = memory.told_lesson("deploy cache", tell, 3).first()
    assert (r.edges, r.lesson, r.samples, round(r.agreement, 4), r.unreliable) == (2, "keep the cache", 2, 0.3333, True)
    assert sorted(seen) == [(0, 2, 0.0), (1, 2, 0.7), (2, 2, 0.7), (3, 2, 0.7)]
    r = memory.told_lesson("deploy cache", tell, 1).first()
    assert (r.lesson, r.samples, r.agreement, r.unreliable) == ("keep the cache", 0, None, False)
    assert memory.told_lesson("nothing known", tell, 3).first().lesson is None
    assert [x.id for x in memory.lesson("nothing known", 1, [1.0, 0.1]).collect()] == [2]  # by similarity
