"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tracewell.functions import hashing
from tracewell.functions import text as tx
from tracewell.operators import blocks, bm25, consolidate, dml, fusion, graph, hops, ingest, novelty, patterns, predict, trace, vector
from tracewell.plans import router
from tracewell.schema import TABLES, ensure_schema, entries
from tracewell.session import materialise

NOW = 1_735_689_600


def column(spark, c, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(c(F.col("t"))).collect()]


def test_tokens(spark):
    got = column(spark, tx.tokens, "The Build für 部署失败 v2", "", None, "é")
    assert got == [["build", "f", "ü", "r", "部署", "署失", "失败", "v2"], [], [], ["é"]]


def test_polarity_and_retraction(spark):
    texts = ["tests passed", "build failed", "deadlock resolved", "unresolved", "invoke", "unsuccessful run", "successfully done", "死锁", "修复死锁"]
    got = column(spark, tx.outcome_polarity, *texts)
    assert got == [True, False, True, None, None, None, True, False, True]
    assert column(spark, tx.is_retraction, "User no longer likes tea", "likes tea") == [True, False]


def test_entities(spark):
    assert column(spark, tx.entity_tokens, "Then Melanie's dog met Bob. Alice left and Paris won.", "he saw The King", None) == [["melanie", "bob", "paris"], ["king"], []]


def test_dates_and_estimates(spark):
    assert column(spark, tx.date_tokens, "[2025-06-05] due 2025-06-07, not 2025-02-30 or 12025-06-07") == [["2025-06-07"]]
    assert column(spark, tx.estimate_tokens, "abcde部署", "") == [4, 0]


def test_redaction(spark):
    assert column(spark, hashing.redact, "use sk-abcdefgh12  now", "Bearer abc", "plain  text") == ["use [REDACTED] now", "Bearer [REDACTED]", "plain  text"]


def test_simhash_of_one_word(spark):
    h = hashing.fnv1a("deploy") | hashing.fnv1a("deploy#2") << 64
    assert hashing.simhash128("Deploy") == f"{h:032x}"
    rows = spark.createDataFrame([(1, "0" * 32), (2, "0" * 31 + "3"), (3, "f" * 32), (4, "8" + "0" * 30 + "1")], "id long, code string")
    assert sorted(map(tuple, hashing.near_duplicates(rows).collect())) == [(1, 2, 2), (1, 4, 2), (2, 4, 2)]


def _bm25(docs, query):
    tok = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, tok)) / len(docs)
    out = []
    for t in tok:
        s = 0.0
        for q in query.split():
            df = sum(q in x for x in tok)
            if q in t:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * t.count(q) * 2.2 / (t.count(q) + 1.2 * (0.25 + 0.75 * len(t) / avg))
        out.append(s)
    return out


def test_bm25_model_ties_and_empty(spark):
    docs = ["deploy deploy server", "deploy server crash cache memory", "cache", "", "cache"]
    d = spark.createDataFrame([(i * 5, t) for i, t in enumerate(docs)], "id long, text string")
    q = spark.createDataFrame([(1, "deploy deploy cache"), (2, "nothing known")], "qid long, query string")
    got = {r.id: r.score for r in bm25.bm25(d, q, 10).collect()}
    want = {str(i * 5): s for i, s in enumerate(_bm25(docs, "deploy deploy cache")) if s}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    tied = [r.id for r in bm25.bm25(d, q, 10).orderBy("rank").collect() if r.id in ("10", "20")]
    assert tied == ["10", "20"]
    assert bm25.bm25(d.limit(0), q, 3).count() == 0


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_rrf_quota_budget(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid long, id string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "qid long, id string, rank long")
    got = [(r.id, round(r.score, 6)) for r in fusion.rrf([a, b]).orderBy("rank").collect()]
    assert got == [("y", round(1 / 61 + 1 / 62, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]
    assert [r.id for r in fusion.budget(a, 100, F.lit(60)).collect()] == ["x"]
    assert fusion.budget(a, 0, F.lit(60)).count() == 2
    assert [r.id for r in fusion.quota(a, 1, F.lit(True)).collect()] == ["x"]


EDGE = "id long, from_id string, to_id string, relation string, confidence double, task_tag string, outcome_polarity string, valid_to long, event_time long, discovered_by string"


def edges_of(spark, *rows):
    return spark.createDataFrame([(i, f, t, rel, c, tag, p, None, i * 10, "agent") for i, f, t, rel, c, tag, p in rows], EDGE)


def test_chains(spark):
    e = edges_of(spark, (1, "a", "b", "caused", 0.9, "x", None), (2, "b", "c", "caused", 0.9, "x", None), (3, "c", "d", "caused", 0.9, "x", None), (4, "q", "c", "caused", 0.4, "x", None))
    anchor = spark.createDataFrame([(1, 3)], "qid long, id long")
    got = [(r.path, round(r.confidence, 6)) for r in trace.cause_chains(e, anchor).orderBy("rank").collect()]
    assert got == [("3>2>1", 0.729), ("3>2", 0.81)]
    forward = [r.path for r in trace.effect_chains(e, spark.createDataFrame([(1, 1)], "qid long, id long")).orderBy("rank").collect()]
    assert forward == ["1>2>3", "1>2", "1"]
    loop = edges_of(spark, (7, "s", "s", "caused", 1.0, "x", None))
    assert trace.cause_chains(loop, spark.createDataFrame([(1, 7)], "qid long, id long")).count() == 2


def test_spread_signs_and_bounds(spark):
    e = edges_of(spark, (1, "a", "b", "caused", 1.0, "x", None), (2, "a", "c", "prevented", 1.0, "x", None), (3, "c", "d", "caused", 1.0, "x", None), (4, "a", "n", "no_effect", 1.0, "x", None))
    seeds = spark.createDataFrame([("a", 1.0)], "node string, q double")
    got = {r.node: round(r.activation, 6) for r in graph.spread(graph.build(e), seeds).collect()}
    assert got == {"a": 1.0, "b": 0.7, "c": -0.21, "d": -0.147}
    plain = {r.node for r in graph.spread(graph.build(e), seeds, inhibition=False).collect()}
    assert plain == {"a", "b"}
    back = {r.node for r in graph.spread(graph.build(e), spark.createDataFrame([("b", 1.0)], "node string, q double"), reverse=True).collect()}
    assert back == {"a", "b"}


def test_components_and_degrees(spark):
    e = edges_of(spark, (1, "a", "b", "caused", 1.0, "x", None), (2, "c", "b", "caused", 1.0, "x", None), (3, "d", "d", "caused", 1.0, "x", None))
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert tuple(graph.component_stats(nodes, e).first()) == (3, 3, 2, 3)
    long = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, graph.connected_components(long).collect()))
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_overlap_of_a_hub_equals_sets(spark):
    """A hub of 300 leaves, loops, repeated and opposite edges: equal to sets, and far fewer rows than its degree squared."""
    import random

    rng = random.Random(2)
    pairs = [("hub", f"n{i}") for i in range(300)] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(150)] + [("n1", "hub"), ("hub", "n1"), ("alone", "alone"), ("hub", "hub")]
    e = edges_of(spark, *[(i, a, b, "caused", 1.0, "x", None) for i, (a, b) in enumerate(pairs)])
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for i, (a, b) in enumerate(pairs):
        x, y = near.get(a, set()) - {b}, near.get(b, set()) - {a}
        want[i] = (len(x & y), round(len(x & y) / len(x | y), 9) if x | y else 0.0)
    assert {r.id: (r.shared, round(r.jaccard, 9)) for r in graph.neighbour_overlap(e).collect()} == want


def test_refute_grades(spark):
    e = edges_of(spark, (1, "a", "b", "caused", 1.0, "x", None), (2, "a", "c", "caused", 1.0, "x", None), (3, "c", "b", "caused", 1.0, "x", None), (4, "x", "y", "caused", 1.0, "x", None))
    got = {r.id: (r.confounder, r.corroboration) for r in graph.refute(e).collect()}
    assert got[1] == (1, 1) and got[4] == (-1, -1)


def test_mining_thresholds(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(1, words), (2, words[:9] + ["lam"]), (3, words[:6] + ["p", "q", "r", "s"]), (4, words)]
    items = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {(r.a, r.b): round(r.similarity, 6) for r in patterns.similar_pairs(items).collect()}
    assert got == {(1, 2): round(9 / 11, 6), (2, 4): round(9 / 11, 6)}  # equal sets and 6/14 are left out


def test_classes_of_copies_make_no_pairs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, words) for i in range(500)] + [(1000, words[:9] + ["lam"]), (1001, words[:9] + ["lam"]), (2000, ["other"]), (3000, [])]
    members, links = patterns.similar_classes(spark.createDataFrame(rows, "id long, tokens array<string>"))
    assert {r.id: r.set for r in members.collect()} == {**{i: 0 for i in range(500)}, 1000: 1000, 1001: 1000, 2000: 2000, 3000: 3000}
    assert [(r.a, r.b, round(r.similarity, 6)) for r in links.collect()] == [(0, 1000, round(9 / 11, 6))]


def test_classify_relations(spark):
    items = spark.createDataFrame([(1, "x", 1, "build failed"), (2, "x", 2, "all passed"), (3, "y", 3, "all passed"), (4, "y", 4, "hm")], "id long, task_tag string, event_time long, outcome string")
    pairs = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.8), (2, 3, 0.8), (3, 4, 0.8)], "a long, b long, similarity double")
    got = {(r.a, r.b): (r.relation, round(r.confidence, 3)) for r in patterns.classify(pairs, items).collect()}
    assert got == {(1, 2): ("refines", 0.68), (1, 3): ("contradicts", 0.64), (2, 3): ("repeated", 0.72), (3, 4): ("similar_to", 0.8)}


def test_greedy_caps(spark):
    pairs = spark.createDataFrame([(1, i, 1 - i / 100) for i in range(2, 10)], "a long, b long, similarity double")
    assert [b for _, b, _ in patterns.accept(pairs)] == [2, 3, 4, 5, 6]
    assert len(patterns.accept(pairs, most=3)) == 3


def test_strata(spark):
    rows = [("s", "a", True, False), ("s", "b", False, True), ("t", None, True, False), ("t", None, False, True)]
    df = spark.createDataFrame(rows, "signature string, task_tag string, succeeded boolean, failed boolean")
    got = {r.signature: (r.strata, r.confounded, r.simpson) for r in patterns.strata(df).collect()}
    assert got == {"s": (2, False, True), "t": (1, True, False)}


def test_simpson_reversal(spark):
    ev = [(1, "a", "positive")] * 2 + [(1, "a", "negative")] * 3 + [(1, "b", "positive")] * 9
    rows = spark.createDataFrame(ev, "k long, task_tag string, bucket string")
    ref = spark.createDataFrame([(1, "a")], "k long, reference string")
    r = predict.stratified(rows, "k", ref).first()
    assert (r.pooled_positive, r.within_negative, r.others_positive, r.reversed) == (11, 3, 9, True)


def test_contrast(spark):
    rows = spark.createDataFrame([(1, "a", "positive"), (1, "b", "negative"), (2, "a", "mixed")], "k long, side string, bucket string")
    assert {r.k: r.verdict for r in predict.contrast(rows, "k").collect()} == {1: "a", 2: "insufficient"}


CHUNK = "id string, text string, created_at long, q_value double"


def store(spark):
    chunks = spark.createDataFrame([("c1", "restart the payment server", 1, 0.5), ("c2", "deadlock error", 2, 0.5), ("c3", "all tests passed", 3, 0.5)], CHUNK)
    full = spark.createDataFrame([(1, "c1", "c2", "caused", 0.8, "agent", 10, NOW - 10 * 86400, None, "t", 0, None, None, None)], TABLES["causal_edges"])
    return chunks, full


def test_record_falsifies_and_reuses_nodes(spark):
    chunks, edges = store(spark)
    batch = spark.createDataFrame([(2, "restart the payment server", "all tests passed", "caused", 0.7, 20, "t", None)], "id long, decision string, outcome string, relation string, confidence double, event_time long, task_tag string, outcome_polarity string")
    new_chunks, new_edges = dml.record_decisions(chunks, edges, batch, NOW)
    assert new_chunks.count() == 3
    assert {r.id: r.valid_to for r in new_edges.collect()} == {1: NOW, 2: None}
    back = dml.restore(new_edges, spark.createDataFrame([(1,)], "id long"))
    assert back.filter("valid_to is null").count() == 2


def test_downscale_and_collect(spark):
    chunks, edges = store(spark)
    scores = spark.createDataFrame([(1, False)], "id long, protected boolean")
    assert abs(consolidate.downscale_edges(edges, scores, NOW).first().confidence - 0.8 * 0.99**10) < 1e-9


@pytest.fixture
def asleep(spark):
    """A store in which every stage of consolidation has something to do."""
    texts = {"a": "deploy the payment service to the staging cluster", "b": "the deploy failed with a timeout", "c": "again deploy the whole payment service to the staging cluster", "d": "tests passed and it is running", "e": "likes dark mode", "x": "tune the query planner for large joins now", "y": "tune the query planner for large joins today", "z": "it is done and passed"}
    chunks = spark.createDataFrame([(i, t, n, 0.5) for n, (i, t) in enumerate(texts.items())], CHUNK)
    old = NOW - 10 * 86400
    rows = [
        (1, "a", "b", "caused", 0.9, "agent", old, old, None, "t1", 0, None, None, None), (2, "a", "b", "caused", 0.5, "agent", old, old, None, "t1", 0, None, None, None),
        (3, "c", "d", "enabled", 0.8, "agent", old + 5, old, None, "t1", 0, NOW - 86400, None, None), (4, "e", "d", "caused", 0.21, "agent", old, old, None, "t2", 0, None, None, None),
        (5, "x", "z", "caused", 0.6, "user_feedback", old, old, None, "t3", 0, None, None, None), (6, "y", "z", "caused", 0.6, "agent", old, old, None, "t4", 0, None, None, None),
    ]
    edges = spark.createDataFrame(rows, TABLES["causal_edges"])
    facts = spark.createDataFrame([(1, "deploy", "the payment service goes to the staging cluster", "user", "agent", 0.9, old, NOW, None, None, None), (2, "old", "value", "user", "agent", 0.21, old, old, None, None, None)], TABLES["agent_facts"])
    return consolidate.State(edges, chunks, facts, spark.createDataFrame([], TABLES["meta_causal_edges"]))


def test_a_cycle_of_consolidation(spark, asleep):
    new, report = consolidate.consolidate(asleep, NOW)
    r = report.first()
    assert (r.skipped, r.merged, r.collected_edges, r.collected_facts, r.superseded) == (False, 1, 1, 1, 0)
    assert r.protected == 3 and r.replayed == 2  # the failures 1 and 2, of which 2 is merged, and 3, contradicted and lately used
    edges = {e.id: e for e in new.edges.collect()}
    assert edges[2].valid_to == NOW and edges[4].valid_to == NOW and edges[1].last_accessed_at == NOW and edges[6].last_accessed_at is None
    assert abs(edges[3].confidence - min(0.95, 0.8 * 0.99**5 + 0.05)) < 1e-9  # protected: it ages half as fast
    assert {(m.from_id, m.to_id, m.relation) for m in new.meta.collect()} >= {("a", "c", "refines"), ("x", "y", "repeated")}
    q = {c.id: c.q_value for c in new.chunks.collect()}
    assert abs(q["a"] - (0.5 + 0.1 * (1 + 0.9 * 0.5 - 0.5))) < 1e-9 and q["e"] == 0.5
    assert {f.id: f.valid_to for f in new.facts.collect()} == {1: None, 2: NOW}
    assert asleep.edges.filter("valid_to is null").count() == 6 and asleep.meta.count() == 0  # the old tables are as they were


def test_dry_run_and_gate(spark, asleep):
    same, report = consolidate.consolidate(asleep, NOW, dry_run=True)
    assert same is asleep and report.first().merged == 1 and report.first().replayed == 0
    same, report = consolidate.consolidate(asleep, NOW, consolidate.Config(min_diversity=1.1))
    assert same is asleep and report.first().skipped


def test_supersession_by_a_judge(spark, asleep):
    both = asleep.edges.unionByName(spark.createDataFrame([(9, "a", "d", "caused", 0.9, "agent", NOW, NOW, None, "t1", 0, None, None, None)], TABLES["causal_edges"]))
    state = consolidate.State(both, asleep.chunks, asleep.facts, asleep.meta)
    yes = lambda pairs: pairs.withColumn("supersedes", F.col("old") == 1)
    new, report = consolidate.consolidate(state, NOW, judge=yes)
    assert report.first().superseded == 1 and {e.id: e.valid_to for e in new.edges.collect()}[1] == NOW
    new, _ = consolidate.consolidate(state, NOW, consolidate.Config(annotate=True), judge=yes)
    assert {e.id: e.superseded_by for e in new.edges.collect()}[1] == 9


def test_miner_with_facts(spark):
    rows = [(1, "rewrote the parser module in typescript for speed", "tests passed", "t1", 5), (2, "rewrote the lexer module in typescript for speed", "build failed", "t2", 6), (3, "rewrote the lexer module in typescript for speed today", "build failed", "t2", 7)]
    entries = spark.createDataFrame(rows, "id long, decision string, outcome string, task_tag string, event_time long")
    facts = spark.createDataFrame([(7, "speed", "rewrote the parser module in plain typescript", "user", None)], "id long, key string, value string, scope string, valid_to long")
    got = {(r.from_id, r.to_id): (r.relation, round(r.confidence, 6), r.confounded) for r in patterns.mine(entries, facts).collect()}
    assert got[("fact:7", "1")][0] == "similar_to" and abs(got[("fact:7", "1")][1] - 5 / 6 * 0.8 * 0.5) < 1e-6 and got[("fact:7", "1")][2]
    assert got[("1", "2")][0] == "contradicts" and not got[("1", "2")][2] and ("2", "3") not in got  # 2 is a part of 3


def test_contradicted_elsewhere(spark):
    rows = [(1, "fix the cache layer now", "failed"), (2, "fix the cache layer now", "passed"), (3, "other words entirely here", "failed")]
    e = spark.createDataFrame(rows, "id long, decision string, outcome string")
    assert sorted(r.id for r in consolidate.contradicted(e).collect()) == [1, 2]


def test_facts_upsert_and_replace(spark):
    schema = "id long, key string, value string, scope string, confidence double, updated_at long, valid_to long"
    facts = spark.createDataFrame([(1, "lang", "rust", "user", 0.5, 1, None), (2, "lang", "go", "user", 0.5, 1, 5)], schema)
    batch = spark.createDataFrame([(3, "lang", "go", "user", 0.9)], "id long, key string, value string, scope string, confidence double")
    got = {r.value: (r.valid_to, r.confidence) for r in dml.upsert_facts(facts, batch, 7, replace=True).collect()}
    assert got == {"rust": (7, 0.5), "go": (None, 0.9)}


def test_hint_guards(spark):
    e = spark.createDataFrame([(1, "user likes green tea a lot", "x", "t", 5, None), (2, "appointment on 2025-06-10 with green tea club", "x", "t", 5, None), (3, "user no longer likes green tea", "x", "t", 5, None), (4, "user likes green tea a lot", "x", "u", 5, None)], "id long, decision string, outcome string, task_tag string, event_time long, valid_to long")
    hints = spark.createDataFrame([(9, "likes green tea", "t", 6), (8, "green tea club moved, 2025-06-10", "t", 6)], "hint long, text string, task_tag string, event_time long")
    assert sorted((r.id, r.hint) for r in dml.supersede_by_hint(e, hints).collect()) == [(1, 8), (1, 9), (2, 9)]


def test_hops(spark):
    chunks = spark.createDataFrame([(x, f"{x} word", 1, 0.5) for x in "abcd"], CHUNK)
    e = edges_of(spark, (1, "a", "b", "caused", 1.0, "x", None), (2, "b", "c", "caused", 0.5, "x", None), (3, "c", "d", "caused", 0.5, "x", None)).withColumn("discovered_by", F.lit("distill"))
    q = spark.createDataFrame([(0, "d word")], "qid long, query string")
    got = [(r.id, r.hop) for r in hops.hop_expansion(entries(e, chunks), spark.createDataFrame([(0, 1)], "qid long, id long"), q, 9).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]


def test_schema_evolution(spark):
    old = spark.createDataFrame([(1, "a", "b", "caused", 0.5, 77)], "id long, from_id string, to_id string, relation string, confidence double, created_at long")
    new = ensure_schema(old, "causal_edges")
    assert new.first().event_time == 77 and new.first().access_count == 0
    assert ensure_schema(new, "causal_edges").schema == new.schema


@pytest.mark.parametrize("query,intent", [("Why did the deploy fail?", "causal"), ("what is the tech stack", "fact"), ("recent decisions", "directory"), ("show the multi-hop links", "chain"), ("yesterday evening", "fact"), ("hello", "unified"), ("为什么失败", "causal")])
def test_router(spark, query, intent):
    assert column(spark, router.classify, query) == [intent]


FRIDAY, SATURDAY, MAY = 1_787_270_400, 1_786_752_000, 1_684_000_000
WEEK = 7 * 86400


@pytest.mark.parametrize(
    "query,now,window",
    [
        ("How many plants in the past two weeks?", MAY, (MAY - 2 * WEEK, MAY)),
        ("Which book did I finish a week ago?", FRIDAY, (FRIDAY - 2 * WEEK, FRIDAY - WEEK)),
        ("I went one week ago", FRIDAY, (FRIDAY - 2 * WEEK, FRIDAY - WEEK)),
        ("I received jewelry last Saturday from whom?", FRIDAY, (SATURDAY, SATURDAY + 86399)),
        ("I saw her last Saturday", SATURDAY, (SATURDAY - WEEK, SATURDAY - WEEK + 86399)),
        ("spent on items last month?", MAY, (1_680_307_200, 1_682_899_199)),
        ("raised since the start of the year?", MAY, (1_672_531_200, MAY)),
        ("What time did I go to bed yesterday?", MAY, (1_683_849_600, 1_683_935_999)),
        ("What did I buy at the store?", MAY, None),
        ("How do you make coffee?", MAY, None),
        ("last day", MAY, None),
        ("last 99999999999999999 weeks", MAY, None),
        ("during june", MAY, (1_685_577_600, 1_688_169_599)),
    ],
)
def test_time_windows(spark, query, now, window):
    r = spark.range(1).select(router.time_window(F.lit(query), F.lit(now).cast("long")).alias("w")).first().w
    assert (tuple(r) if r else None) == window


def test_plans(spark):
    rows = [(0, "How many items of clothing did I buy from Zara?"), (1, "how many days ago did I go"), (2, "what time do I go to bed"), (3, None)]
    got = {r.qid: r for r in router.plan(spark.createDataFrame(rows, "qid long, query string"), F.lit(MAY).cast("long")).collect()}
    assert got[0].aggregation and got[0].entities == ["items", "clothing", "zara"] or got[0].entities == ["clothing", "zara"]
    assert not got[1].aggregation and not got[2].aggregation and got[3].window is None


def test_facts_of_a_batch_supersede_each_other(spark):
    facts = spark.createDataFrame([(1, "lang", "rust", "user", "a", 0.5, 1, 1, None, None, None), (2, "lang", "go", "user", "a", 0.5, 1, 1, 5, 1, None)], "id long, key string, value string, scope string, source string, confidence double, created_at long, updated_at long, valid_to long, superseded_by long, embedding_model string")
    batch = spark.createDataFrame([(3, "lang", "go", "user", 0.9), (4, "lang", "zig", "user", 2.0), (5, "os", "bsd", "user", 0.1)], "id long, key string, value string, scope string, confidence double")
    got = {r.value: (r.id, r.confidence, r.created_at, r.valid_to, r.superseded_by) for r in dml.upsert_facts(facts, batch, 7, replace=True).collect()}
    assert got == {"rust": (1, 0.5, 1, 7, 2), "go": (2, 0.9, 1, 7, 4), "zig": (4, 1.0, 7, None, None), "bsd": (5, 0.1, 7, None, None)}
    kept = {r.value: (r.valid_to, r.superseded_by) for r in dml.upsert_facts(facts, batch.limit(0), 7).collect()}
    assert kept == {"rust": (None, None), "go": (5, 1)}


def test_facts_retired_by_hint(spark):
    facts = spark.createDataFrame([(1, "milk", "drinks almond milk daily", "user", None), (2, "milk", "switched from almond milk to oat milk", "user", None), (3, "milk", "no longer drinks almond milk", "user", None), (4, "tea", "drinks almond milk daily", "user", None)], "id long, key string, value string, scope string, valid_to long")
    hints = spark.createDataFrame([("milk", "user", "almond milk", 2)], "key string, scope string, hint string, exclude long")
    assert [r.id for r in dml.retire_facts_by_hint(facts, hints, 9).filter("valid_to = 9").collect()] == [1]


def test_later_schemas_are_refused(spark):
    with pytest.raises(ValueError):
        ensure_schema(spark.createDataFrame([(1,)], "id long"), "chunks", version=13)


def test_agreement_of_copies(spark):
    rows = spark.createDataFrame([(1, 1, "red fox"), (1, 2, "fox red"), (1, 3, "red hen"), (2, 4, "alone")], "qid long, id long, text string")
    got = {r.qid: round(r.agreement, 6) for r in novelty.agreement(rows).collect()}
    assert got == {1: round((1 + 2 / 3) / 3, 6), 2: 1.0}


def test_numbered_over_many_parts(spark):
    from tracewell.operators.blocks import numbered

    rows = [(r.id, r.place) for r in numbered(spark.range(1000).repartition(7), F.col("id").desc()).collect()]
    assert sorted(rows) == [(i, 1000 - i) for i in range(1000)]



def test_blocks_give_the_same_pairs(spark, monkeypatch):
    items = spark.range(50).selectExpr("nullif(id, 7) as id", "id % 5 as a")
    asked = spark.range(23).selectExpr("nullif(id, 3) as qid", "id % 5 as b")
    where = F.col("a") == F.col("b")
    whole = [sorted(map(str, blocks.against(items, asked, "id", "qid", w).collect())) for w in (None, where)]
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    assert [sorted(map(str, blocks.against(items, asked, "id", "qid", w).collect())) for w in (None, where)] == whole
    assert len(whole[0]) == 50 * 23
    assert blocks.against(items, asked.limit(0), "id", "qid").count() == 0


def test_replies_are_parsed():
    one = '{"type": "Lesson", "description": " a }", "date": "2025-02-30", "supersedes": "null"}'
    want = {"kind": "lesson", "text": "a }", "date": "2025-03-01", "supersedes": None, "causal_relation": None, "decision": None}
    for reply in (one, f"[{one}]", f'```json\n{{"items": [{one}]}}\n```', f'[{one}, {{"text": "cut', f"so: {one} and {{bad}}"):
        assert ingest.parse_items(reply, "2025-03-01") == [want], reply
    assert ingest.parse_items('[{"text": ""}, 3, {"text": "b", "causal_relation": "Enabled", "kind": "fact"}]')[0]["kind"] == "causal"
    assert ingest.parse_items(None) == ingest.parse_items("no") == ingest.parse_items("3") == []


def test_distilled_items(spark):
    kinds = "id long, kind string, text string, date string, supersedes string, causal_relation string, decision string, task_tag string"
    rows = [(10, "fact", "User likes green tea daily", "2025-01-01", None, None, None, "t"), (11, "fact", "User likes green tea daily", "2025-01-01", None, None, None, "t"), (12, "causal", "tests passed", "2025-01-02", None, "enabled", "ran the suite", None), (13, "event", "User switched drinks", "2025-01-03", "likes green tea", None, None, "t")]
    chunks = spark.createDataFrame([], "id string, text string, created_at long, q_value double")
    edges = ensure_schema(spark.createDataFrame([], "id long"), "causal_edges")
    batch = spark.createDataFrame(rows, kinds)
    for _ in range(2):  # a second time changes nothing
        chunks, edges = (materialise(x, "t") for x in ingest.record_distilled(chunks, edges, batch, NOW))
        texts = {r.id: r.text for r in chunks.collect()}
        got = {r.id: (texts[r.from_id], texts[r.to_id], r.relation, r.confidence, r.valid_to, r.superseded_by) for r in edges.collect()}
        tea, void, drinks = "[2025-01-01] User likes green tea daily", "[2025-01-03] Cancelled/superseded: [2025-01-01] User likes green tea daily", "[2025-01-03] User switched drinks"
        assert got == {10: (tea, tea, "caused", 0.6, NOW, 13), 12: ("ran the suite", "[2025-01-02] tests passed", "enabled", 0.7, None, None), 13: (drinks, drinks, "caused", 0.6, None, None), -10: (void, void, "caused", 0.6, None, None)}
        assert edges.count() == 4 and chunks.count() == len(texts)


def test_raw_turns(spark):
    turns = spark.createDataFrame([("s", 0, "ann", "hi"), ("s", 1, None, None), ("s", 1, None, None), ("r", 0, "b", "x")], "session string, place long, speaker string, text string")
    chunks, edges = ingest.raw_turns(turns, NOW)
    assert sorted((r.id, r.text) for r in chunks.collect()) == [("raw:r:0", "[r] b: x"), ("raw:s:0", "[s] ann: hi"), ("raw:s:1", "[s] : ")]
    assert [(r.from_id, r.to_id, r.relation, r.confidence) for r in edges.collect()] == [("raw:s:0", "raw:s:1", "no_effect", 0.4)]


def test_session_expansion(spark):
    chunks = spark.createDataFrame([(f"c{c}::s0::{t}", f"apple {c}" if t == 10 else "pear") for c in (1, 2, 3) for t in (0, 2, 10)] + [("odd", "apple"), ("q::session_expansion::1", "apple")], "id string, text string")
    hits = spark.createDataFrame([(0, i) for i in ("c1::s0::10", "c2::s0::0", "c2::s0::2", "q::session_expansion::1", "gone::s0::1")] + [(1, "c2::s0::0"), (1, "c2::s0::2"), (1, "c1::s0::0")], "qid long, id string")
    asked = spark.createDataFrame([(0, "apple 1 fig"), (1, "the")], "qid long, query string")
    def got(slots):
        rows = fusion.expand_sessions(hits, chunks, asked, slots).orderBy("qid", "rank").collect()
        return [[r.id.replace("::s0", "") for r in rows if r.qid == q] for q in (0, 1)]
    assert got(2) == [["c1::0", "c2::0"], ["c2::0", "c2::2"]]
    assert got(5) == [["c1::0", "c1::2", "c2::0", "c2::2", "c1::10"], ["c2::0", "c2::2", "c2::10", "c1::0", "c1::2"]]
    assert [len(x) for x in got(50)] == [6, 6]


def test_link_audit(spark):
    facts = spark.createDataFrame([(1, "drink", "green tea daily", None), (2, "x", "unrelated", None), (3, "drink", "green tea daily", 5)], "id long, key string, value string, valid_to long")
    chunks = spark.createDataFrame([(1, "green tea drink"), (2, "daily green tea"), (3, "other")], "id long, text string")
    assert graph.link_audit(facts, chunks).first().asDict() == {"facts": 2, "linked": 1, "links": 2, "most_links": 2, "components": 3, "largest": 3, "isolated": 2}
    none = graph.link_audit(facts, chunks, df_limit=1).first()
    assert (none.linked, none.links, none.components, none.isolated) == (0, 0, 5, 5)


def brute_refute(edges, sample=20, placebos=5):
    """edges: {id: (from, to)}; every test as the reference describes it, paths by depth-first search."""
    import hashlib
    from collections import Counter

    out, near = {}, {}
    for e, (a, b) in edges.items():
        out.setdefault(a, []).append((b, e))
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    outs, ins = Counter(a for a, _ in edges.values()), Counter(b for _, b in edges.values())

    def path(at, to, without, left, seen):
        return left > 0 and any(e != without and (b == to or b not in seen and path(b, to, without, left - 1, seen | {b})) for b, e in out.get(at, []))

    def reach(c):
        level, all_ = {c}, set()
        for _ in range(3):
            level = {b for x in level for b, _ in out.get(x, [])}
            all_ |= level
        return all_

    md5 = lambda c: hashlib.md5(str(c).encode()).hexdigest()
    chosen = sorted(outs, key=md5)[: sample + 1]
    got = {}
    for e, (a, b) in edges.items():
        x, y = near.get(a, set()) - {b}, near.get(b, set()) - {a}
        j = len(x & y) / len(x | y) if x | y else 0
        tried = [c for c in chosen if c not in (a, b) and abs(outs[c] - outs[a]) <= outs[a] * 0.5 + 1][:placebos]
        share = sum(b in reach(c) for c in tried) / len(tried) + 0.1 if tried else 0
        tests = [1 if j >= 0.15 else -1 if j < 0.03 else 0, 1 if path(a, b, e, 4, {a}) else 0 if ins[b] >= 2 else -1, 0 if len(tried) < 3 else 1 if round(share, 9) <= 0.5 else -1 if round(share, 9) > 1 else 0]
        good, bad = tests.count(1), tests.count(-1)
        got[e] = (*tests, "A" if good == 3 else "B" if good == 2 and not bad else "C" if not bad else "F" if bad >= 2 else "D")
    return got


@pytest.mark.parametrize("nodes, n", [(12, 30), (40, 70), (60, 60)])
def test_refute_equals_brute_force(spark, nodes, n):
    import random

    rng = random.Random(nodes)
    edges = {i: (rng.randrange(nodes), rng.randrange(nodes)) for i in range(n)} | {900: (700, 701), 901: (700, 701), 902: (710, 711), 903: (710, 712), 904: (712, 713), 905: (713, 714), 906: (714, 711)}
    df = spark.createDataFrame([(i, a, b, None) for i, (a, b) in edges.items()], "id long, from_id long, to_id long, valid_to long")
    assert {r.id: (r.confounder, r.corroboration, r.placebo, r.grade) for r in graph.refute(df).collect()} == brute_refute(edges)


def test_refute_edges_grades_every_edge(spark):
    from tracewell import catalogue

    d = "/root/testdata/sf0.001"
    links = {r.id: (r.from_id, r.to_id) for r in catalogue._links(spark, d).filter("valid_to is null").collect()}
    got = {r.id: (r.confounder, r.corroboration, r.placebo, r.grade) for r in catalogue.queries()["refute_edges"](spark, d).collect()}
    assert got == brute_refute(links)


def test_simhash_query_equals_brute_force(spark):
    from tracewell import catalogue

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("char_length(text) >= 20").select("doc_id", "text").collect()
    codes = {r.doc_id: int(hashing.simhash128(r.text), 16) for r in docs}
    first = {}
    for i in sorted(codes):
        first.setdefault(codes[i], i)
    assert len(first) < len(codes)
    want = [("member", first[c], i, 0) for i, c in codes.items()]
    names = sorted(first.items(), key=lambda x: x[1])
    want += [("pair", a, b, (x ^ y).bit_count()) for k, (x, a) in enumerate(names) for y, b in names[k + 1 :] if (x ^ y).bit_count() <= 2]
    assert sorted(map(tuple, catalogue.queries()["simhash_near_duplicates"](spark, d).collect())) == sorted(want)


def test_cross_session_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    edges = [(i, f"{t}{rng.randrange(12)}", f"{t}{rng.randrange(12)}", rng.randrange(60, 100) / 100, t) for i in range(60) for t in ["ab"[i % 2]]]
    meta = [(i, f"a{rng.randrange(12)}", f"b{rng.randrange(12)}", rng.randrange(40, 100) / 100) for i in range(6)]

    def walks(start):  # (at, confidence) of chains of up to 3 edges from an edge on
        level, out = [(e[1], e[3]) for e in edges if e[0] == start], []
        for _ in range(3):
            out += level
            level = [(e[1], c * e[3]) for at, c in level for e in edges if e[2] == at and c * e[3] >= 0.5]
        return out

    own = {}
    for _, a, _, _, t in edges:
        own[a] = min(t, own.get(a, t))
    want = {}
    for first in range(60):
        for node, c1 in walks(first):
            near = sorted([(-c, i, b if a == node else a) for i, a, b, c in meta if node in (a, b)])[:3]
            met = [(e[0], -c * c3) for c, _, other in near for e in edges if e[2] == other and e[4] != own.get(node) for _, c3 in walks(e[0])]
            for second, c in met or [(None, 1.0)]:
                want[first, second] = max(want.get((first, second), 0), c1 * c)
    ranked = sorted(want, key=lambda k: (-round(want[k], 9), k[0], k[1] is None, k[1] or 0))
    e = spark.createDataFrame([(*x[:3], "caused", *x[3:], None, None) for x in edges], "id long, from_id string, to_id string, relation string, confidence double, task_tag string, outcome_polarity string, valid_to long")
    m = spark.createDataFrame([(*x, None) for x in meta], "id long, from_id string, to_id string, confidence double, valid_to long")
    anchors = e.select(F.lit("q").alias("qid"), "id")
    for limit in (20, 10_000):
        got = trace.cross_session(e, m, anchors, limit=limit).orderBy("rank").collect()
        assert [(r.first_edge, r.second_edge) for r in got] == ranked[:limit]
        assert all(math.isclose(r.confidence, want[r.first_edge, r.second_edge]) for r in got)
    assert any(b for _, b in want) and any(b is None for _, b in want)


def test_supersede_hints_equals_brute_force(spark):
    from tracewell import catalogue

    d = "/root/testdata/sf0.001"
    held = lambda df, c: df.withColumn("_w", tx.tokens(F.col(c))).withColumn("_d", tx.date_tokens(F.col(c))).withColumn("_r", tx.is_retraction(F.col(c))).collect()
    words = lambda r: {w for w in r._w if not (w.isascii() and w.isdigit())}
    turns = spark.read.parquet(f"{d}/conversations.parquet").withColumn("said", F.concat("role", F.lit(": "), "text"))
    want = set()
    olds = [(r, words(r)) for r in held(catalogue._entries(spark, d), "decision") if not r._r and r.valid_to is None]
    for h in held(turns, "said"):
        w, tag, at = words(h), f"t{h.conv_id % 5}", h.conv_id * 1000 + h.turn
        for o, x in olds:
            shared = len(w & x)
            if o.task_tag == tag and o.event_time <= at and not set(o._d) & set(h._d) and shared >= 2 and shared >= 0.5 * min(len(w), len(x)):
                want.add((o.id, h.conv_id * 100 + h.turn))
    got = [tuple(r) for r in catalogue.queries()["supersede_hints"](spark, d).collect()]
    assert want and len(got) == len(want) and set(got) == want
