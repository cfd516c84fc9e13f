"""Steps whose work has to grow with the input: small cases with known results, and what is written on the way."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import calls
from tracewell.operators import backfill, blocks, bm25, consolidate, dml, drain, fusion, graph, hops, inverted, nearest, patterns, vector
from tracewell.plans import supplement


@pytest.mark.parametrize("part", [2, 1024])
def test_other_paths_lists_nodes_once(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "LIST", part)
    held, write = {}, graph.materialise

    def seen(df, name):
        out = write(df, name)
        held[name] = max(held.get(name, 0), out.count())
        return out

    monkeypatch.setattr(graph, "materialise", seen)
    r = random.Random(5)
    edges = [(r.randrange(14), r.randrange(14)) for _ in range(30)]
    live = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "id long, from_id long, to_id long")
    got = {hops: {tuple(x) for x in graph._other_paths(live, hops).collect()} for hops in (2, 3, 4, 5)}

    def led(a, b, hops):
        if edges.count((a, b)) > 1:
            return True
        now = {(a,)}
        for _ in range(hops):
            now = {(*p, y) for p in now for x, y in edges if p[-1] == x and x != y and (y == b or y not in p) and not (len(p) == 1 and y == b)}
            if any(p[-1] == b for p in now):
                return True
            now = {p for p in now if p[-1] != b and p[-1] != a}
        return False

    for hops in got:
        assert got[hops] == {e for e in edges if led(*e, hops)}
    assert held["refute-walks"] <= 14 * 14 and ("refute-ahead" not in held or held["refute-ahead"] <= 30 * 14)


def test_four_hops_keep_no_walks_of_edges(spark, monkeypatch):
    names, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: names.append(name) or write(df, name))
    graph._other_paths(spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 1, 3)], "id long, from_id long, to_id long"), 4).collect()
    assert "refute-ahead" not in names and "refute-behind" not in names


@pytest.mark.parametrize("tile", [3, 32768])
def test_nearest_in_tiles_and_blocks(spark, monkeypatch, tile):
    for name, value in (("TILE", tile), ("LEAST_TILE", tile), ("BLOCK", tile + 1), ("CELLS", 8)):
        monkeypatch.setattr(nearest, name, value)
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0], None, [0.0, 0.0], [1.0], [1.0, None], [], [-1.0, 0.0]])]
    items = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(0, [3.0, 0.0]), (1, [5.0]), (2, None)], "qid long, query_vector array<double>")
    found = vector.semantic(items, asked, 3)
    assert sorted((r.qid, r["rank"], r.id, round(r.similarity, 6)) for r in found.collect()) == [(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 3, 0.707107), (1, 1, 6, 1.0), (1, 2, 0, 0.0), (1, 3, 1, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0), (2, 3, 2, 0.0)]
    plan = dml.recurrent(items, items, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_drain_keeps_no_pairs(spark, monkeypatch):
    held, write = {}, drain.materialise

    def seen(df, name):
        out = write(df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(drain, "materialise", seen)
    turns = spark.createDataFrame([(i, 0, "user", "t", i, [1.0, float(i % 2)], 1 if i == 0 else None) for i in range(40)], "session_id long, turn_index int, speaker string, text string, event_time long, embedding array<double>, distilled_at long")
    outcome = drain.drain(turns, lambda said: said, 9, 0.5)[2]
    assert [(r.prior, r.distilled) for r in outcome.orderBy("session_id").collect()] == [(0 if i % 2 == 0 else 0 if i == 1 else 1, True) for i in range(1, 40)]
    assert max(held.values()) <= 40


def test_unlike_sets_are_refused_where_they_meet(spark):
    r = random.Random(7)
    base = [{f"w{r.randrange(60)}" for _ in range(r.randrange(4, 16))} for _ in range(12)]
    sets = [b ^ {f"w{r.randrange(60)}" for _ in range(r.randrange(3))} for b in base for _ in range(4)]
    items = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, tokens array<string>")
    found = patterns.similar_classes(items)[1]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) >= 0.65 * len(x | y)}
    assert want and {(x.a, x.b) for x in found.collect()} == want
    assert "bit_count" in found._jdf.queryExecution().executedPlan().toString()


def test_hints_refuse_unlike_texts_where_they_meet(spark):
    r = random.Random(3)
    words = ["".join(chr(97 + int(c)) for c in f"{i:04d}") + "x" for i in range(50)]
    said = [{words[r.randrange(50)] for _ in range(r.randrange(3, 14))} for _ in range(40)]
    row = lambda i: (i, " ".join(sorted(said[i])), "t", i)
    entries = spark.createDataFrame([(*row(i), None) for i in range(40)], "id long, decision string, task_tag string, event_time long, valid_to long")
    hints = spark.createDataFrame([row(i) for i in range(40)], "hint long, text string, task_tag string, event_time long")
    found = dml.supersede_by_hint(entries, hints)
    want = {(i, h) for i in range(40) for h in range(i, 40) if len(said[i] & said[h]) >= max(2, 0.5 * min(len(said[i]), len(said[h])))}
    assert {(x.id, x.hint) for x in found.collect()} == want
    assert "bit_count" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("needles", [3, 500_000])
def test_texts_that_contain_a_question_are_looked_up(spark, monkeypatch, needles):
    monkeypatch.setattr(blocks, "NEEDLES", needles)
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abAé.😀 ") for _ in range(n))
    texts = [(i, word(r.randrange(60)), r.choice(["s", "t", None])) for i in range(80)] + [(90, None, "s"), (91, "", "s"), (92, "x" * 70 + "Y", "s")]
    asked = [(i, word(r.randrange(1, 9)), r.choice(["s", "t", None])) for i in range(40)] + [(90, None, "s"), (91, "", "s"), (92, "X" * 70, "s"), (93, "x" * 65 + "z", "s")]
    items, queries = spark.createDataFrame(texts, "id long, text string, tag string"), spark.createDataFrame(asked, "qid long, query string, tag string")
    holds = lambda t, q: t is not None and q is not None and q.lower() in t.lower()
    found = blocks.containing(items.drop("tag"), "text", queries.drop("tag"), "query")
    assert sorted((x.id, x.qid) for x in found.collect()) == sorted((i, q) for i, t, _ in texts for q, s, _ in asked if holds(t, s))
    tagged = blocks.containing(items, "text", queries, "query", ("tag",))
    assert sorted((x.id, x.qid, x.tag) for x in tagged.collect()) == sorted((i, q, a) for i, t, a in texts for q, s, b in asked if a == b is not None and holds(t, s))
    assert blocks.containing(items, "text", queries.limit(0).drop("tag"), "query").count() == 0
    for df in (found, tagged):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_searches_for_contained_texts_form_no_pairs_of_all_rows(spark):
    from tracewell.plans.memory import Memory

    chunks = spark.createDataFrame([(f"c{i}", f"text {i} Here", i, 0.5) for i in range(9)], "id string, text string, created_at long, q_value double")
    edges = spark.createDataFrame([(i, f"c{i}", f"c{i + 1}", "caused", 0.5 + i / 100, None) for i in range(8)], "id long, from_id string, to_id string, relation string, confidence double, valid_to long")
    meta = edges.withColumn("pattern", F.lit("p"))
    asked = spark.createDataFrame([(0, "TEXT 3"), (1, "here"), (2, ""), (3, None)], "qid long, query string")
    memory = Memory(chunks, edges, meta, None)
    cause, pattern = memory.trace_cause(asked), memory.search_patterns(asked)
    assert sorted((x.qid, x.id, x["rank"]) for x in cause.collect()) == [(0, 2, 1)] + [(1, i, 8 - i) for i in range(8)]
    assert sorted((x.qid, x.id) for x in pattern.collect()) == [(0, 2), (0, 3)] + [(q, i) for q in (1, 2) for i in range(8)]
    for df in (cause, pattern):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_spread_once_and_only_where_that_can_change_the_nearest(spark, monkeypatch):
    begun, spread = [], graph.spread
    monkeypatch.setattr(graph, "spread", lambda g, seeds, **k: begun.append({(x.name, x.node) for x in seeds.collect()}) or spread(g, seeds, **k))
    monkeypatch.setattr(supplement, "NEAREST", 3)
    text = lambda i: f"{i:02d} " + ("Often" if i < 8 else "Seldom" if i < 10 else "other") + " said"
    q = [0.9 if i in (2, 4, 5, 7, 8) else 0.1 for i in range(14)]
    nodes = spark.createDataFrame([(f"n{i:02d}", text(i), q[i], "t") for i in range(14)], "id string, text string, q_value double, task_tag string")
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "caused", 0.9, True) for i in range(13)], "src string, dst string, relation string, weight double, valid boolean")
    asked = spark.createDataFrame([(k, "t", ["often", "Seldom"]) for k in range(3)], "qid long, task_tag string, entities array<string>")
    shown = spark.createDataFrame([(k, "none") for k in range(3)], "qid long, text string")
    got = sorted((x.qid, x.place, x.id) for x in supplement.seeded_boost(asked, nodes, links, shown).collect())
    assert got == sorted((k, i + 1, n) for k in range(3) for i, n in enumerate(["n02", "n04", "n05", "n08", "n09", "n10"]))
    assert begun == [{("seldom", "n08"), ("seldom", "n09")}]


def test_edges_and_queries_that_name_the_same_meet_once(spark, monkeypatch):
    met, write = {}, bm25.pruned
    monkeypatch.setattr(hops, "pruned", lambda *a: met.setdefault("rows", write(*a)))
    named = ["Then Alice met Bob", "Then Bob left", "Then Carol sat with Dave and Alice", "nobody"]
    edges = spark.createDataFrame([(i, named[i % 4], "") for i in range(200)], "id long, decision string, outcome string")
    asked = spark.createDataFrame([(i, ["Then Bob and Alice", "Then Zoe met Bob", "Then Dave", "who"][i % 4]) for i in range(120)], "qid long, query string")
    holds, wants = [{"alice", "bob"}, {"bob"}, {"carol", "dave", "alice"}, set()], [{"alice", "bob"}, {"bob"}, {"dave"}, set()]
    want = []
    for qid in range(120):
        hits = sorted((-len(wants[qid % 4] & holds[i % 4]), i) for i in range(200) if wants[qid % 4] & holds[i % 4])
        want += [(qid, i, -n, k + 1) for k, (n, i) in enumerate(hits[:7])]
    assert sorted((x.qid, x.id, x.overlap, x["rank"]) for x in hops.entity_search(edges, asked, 7).collect()) == sorted(want)
    assert met["rows"].count() <= 9


def test_only_opposed_sets_meet(spark, monkeypatch):
    held, write = {}, patterns.materialise

    def seen(df, name):
        out = write(df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(patterns, "materialise", seen)
    r = random.Random(13)
    words = [f"{a}{b}x" for a in "bcdfg" for b in "klmnp"]
    said = [" ".join(r.sample(words[:12], r.randrange(3, 9))) for _ in range(70)]
    rows = [(i, said[i % 60], "it did fail" if i % 7 == 0 or i >= 60 else "passed" if i % 3 else "so") for i in range(70)]
    table = lambda of: spark.createDataFrame(of, "id long, decision string, outcome string")
    alike = lambda x, y: len(x & y) >= 0.65 * len(x | y)
    bad = lambda t: "fail" in t
    want = {i for i, d, o in rows for _, e, p in rows if bad(o) != bad(p) and alike(set(d.split()), set(e.split()))}
    assert want and {x.id for x in consolidate.contradicted(table(rows)).collect()} == want and held["similar-prefixes"] > 0
    assert consolidate.contradicted(table([(i, d, "passed") for i, d, _ in rows])).count() == 0 and held["similar-prefixes"] == 0


def test_a_batch_is_cut_without_one_task(spark):
    items = spark.range(50).select(F.expr("id * 37 % 50").alias("id"), F.col("id").cast("string").alias("text")).repartition(4)
    for n in (1, 17, 50, 60):
        some = backfill._first(items, n)
        assert sorted(x.id for x in some.collect()) == list(range(min(n, 50)))
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Limit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_postings_are_dealt_once(spark, tmp_path, monkeypatch):
    names, write = [], inverted.materialise
    monkeypatch.setattr(inverted, "materialise", lambda df, name: names.append(name) or write(df, name))
    postings = spark.createDataFrame([(f"t{i % 5}", f"d{i}", 1, 2) for i in range(20)], "term string, id string, tf int, dl int")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    plan = inverted._laid(postings, df, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket#") == 1 and plan.count("Exchange hashpartitioning") == 1
    docs = spark.createDataFrame([(i, f"t{i % 5} t{i} t{i}") for i in range(20)] + [(90, None), (91, "")], "id long, text string")
    index = inverted.InvertedIndex.open(spark, f"file://{tmp_path}/i").append(docs, buckets=4).compact()
    assert index.documents == 22 and index.store.table("postings").agg(F.sum("n")).first()[0] == 35
    assert not {"index-postings", "index-compacted"} & set(names)


def test_stop_words_are_a_set(spark):
    from tracewell.functions import text as tx

    said = spark.createDataFrame([("The cat, and über 我们们 I",)], "text string").select(tx.tokens(F.col("text")).alias("t"))
    assert "array_contains" not in said._jdf.queryExecution().optimizedPlan().toString()
    assert said.first().t == ["cat", "ü", "ber", "我们", "们们"]


def test_a_call_is_graded_once_a_row(spark):
    calls_of = [("write", '{"file_path": "src/a.rs"}', r, e) for r in ("src/a.rs written", "error: no", "error in src/a.rs", "so", None) for e in (None, "success", "timeout")]
    rows = spark.createDataFrame(calls_of, "tool string, arguments string, result string, event string")
    told, result, event = calls.decision(F.col("tool"), F.col("arguments")), F.col("result"), F.col("event")
    got = calls.with_grade(rows, told, result, event)
    related, failed, done = (lambda r: r is not None and "src/a.rs" in r), (lambda r, e: e == "timeout" or (r or "").startswith("error")), (lambda e: e == "success")
    name = lambda r, e: ("failure" if failed(r, e) else "success" if done(e) else "") + (", related" if related(r) else "")
    grade = lambda r, e: calls.GRADES[{"": "none", ", related": "related"}.get(name(r, e), name(r, e))]
    key = lambda x: (x[0] or "", x[1] or "")
    assert sorted(((x.result, x.event, x.decision, x.confidence, x.source) for x in got.collect()), key=key) == sorted(((r, e, "write(src/a.rs)", *grade(r, e)) for _, _, r, e in calls_of), key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_places_in_groups_come_from_ranges(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART_ROWS", 40)
    r = random.Random(3)
    rows = [(None if i % 9 == 0 else i % 3, r.randrange(20), i) for i in range(700)]
    got = blocks.placed(spark.createDataFrame(rows, "g long, v long, i long").repartition(5), "g", F.col("v").desc(), "i").collect()
    want = {}
    for g in {x[0] for x in rows}:
        want |= {i: n for n, (_, i) in enumerate(sorted((-v, i) for k, v, i in rows if k == g), 1)}
    assert len(got) == 700 and {x.i: x.place for x in got} == want


def test_fused_lists_meet_by_question_and_id(spark):
    lists = [spark.range(60).select((F.col("id") % 2).alias("qid"), F.col("id"), (F.floor(F.col("id") / 2) + 1).alias("rank")).repartition(3, "qid") for _ in range(2)]
    fused = fusion.rrf(lists, 5, parts=7)
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert "7), REPARTITION_BY_NUM" in plan
    assert sorted((x.qid, x.rank, x.id) for x in fused.collect()) == [(q, n, str(2 * n - 2 + q)) for q in (0, 1) for n in range(1, 6)]


def test_pairs_retrieved_together_are_dealt_by_counted_rows(spark, monkeypatch):
    r = random.Random(11)
    rows = [(None if i % 50 == 0 else r.randrange(40), r.randrange(9), r.randrange(6)) for i in range(400)]
    monkeypatch.setattr(blocks, "PART_ROWS", 50)
    got = graph.cooccurrence(spark.createDataFrame(rows, "retrieval long, id long, place long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("16), REPARTITION_BY_NUM") == plan.count("Exchange ") == 2 and "Join" not in plan
    first, want = {}, {}
    for g, i, p in rows:
        if g is not None:
            first[g, i] = min(p, first.get((g, i), p))
    for (g, a), p in first.items():
        for (h, b), q in first.items():
            if g == h and p < q and a != b:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(x.from_id, x.to_id): (x.n, round(x.weight, 6)) for x in got.collect()} == {k: (n, round(min(1, 0.2 + 0.05 * (n - 1)), 6)) for k, n in want.items()}
