import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import calls
from tracewell.plans.memory import Memory
from tracewell.sources import commits, jsonl, sessions, wiki
from tracewell.streaming import ingest


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return f"file://{path}"


def test_directory_session(spark, tmp_path):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    write(tmp_path / "chat_history.jsonl", [{"type": "assistant", "content": "x" * 120, "tool_calls": [call("1", "write", '{"path": "a.py"}'), call("2", "read", "{}"), call("3", "read", "{}"), call("4", "write", "{}")]}, "not json", {"type": "tool_result", "tool_call_id": "1", "content": "ok"}, {"type": "tool_result", "tool_call_id": "2", "content": "fine"}, {"type": "tool_result", "tool_call_id": "3", "content": "error: No such file"}])
    write(tmp_path / "events.jsonl", [{"type": "tool_completed", "tool_name": "write", "outcome": "success", "ts": "2026-07-26T06:03:11.008Z"}])
    got = {(r.tool, r.decision, r.outcome, r.failed, r.confidence, r.source, r.task_tag, r.at) for r in sessions.extract(sessions.PARSERS["directory"](spark, f"file://{tmp_path}")).collect()}
    assert got == {("write", "write(a.py)", "ok", False, 0.4, "temporal", "code-edit", 1785045791), ("read", "read({})", "error: No such file", True, 0.65, "rule", "general", None)}


def test_positional_and_call_sessions(spark, tmp_path):
    p = write(tmp_path / "p.jsonl", [{"type": "assistant", "toolCalls": [{"name": "write", "arguments": "1"}, {"name": "write", "arguments": "2"}]}, {"type": "toolResult", "content": "first"}, {"type": "toolResult", "content": "second"}])
    assert sorted((r.decision, r.outcome) for r in sessions.extract(sessions.positional(spark, p)).collect()) == [("write(1)", "first"), ("write(2)", "second")]
    c = write(tmp_path / "c.jsonl", [{"type": "function_call", "call_id": "a", "name": "exec_command", "arguments": "{}"}, {"type": "function_call_output", "call_id": "a", "output": "exited with code 2"}])
    assert [r.failed for r in sessions.extract(sessions.calls(spark, c)).collect()] == [True]


def test_call_rules(spark):
    rows = [("write", '{"file_path": "src/main.rs", "a": 1}', "src/main.rs updated", "success"), ("exec", '{"b": [1], "a": null}', "fatal: x", None), ("Edit", "x" * 60, "conflict", None), ("search", "{}", None, None)]
    df = spark.createDataFrame(rows, "t string, a string, r string, e string")
    d = calls.decision(F.col("t"), F.col("a"))
    got = [tuple(r) for r in df.select(d, calls.task_tag(F.col("t"), F.col("a")), calls.worthy(F.col("t"), F.col("r")), *calls.grade(d, F.col("r"), F.col("e"))).collect()]
    assert got == [("write(src/main.rs)", "code-edit", True, 0.55, "llm_inferred"), ("exec(null)", "general", True, 0.65, "rule"), ("Edit(" + "x" * 50 + "...)", "code-edit", True, 0.65, "rule"), ("search({})", "search", False, 0.3, "temporal")]


def tables(spark):
    chunks = spark.createDataFrame([("a", "deploy server sk-abcdefgh123", 1, 0.5), ("b", "build failed", 1, 0.5), ("c", "unused", 1, 0.5)], "id string, text string, created_at long, q_value double")
    edges = spark.createDataFrame([(1, "a", "b", "caused", 0.9, "agent", 5, None, "t", None)], "id long, from_id string, to_id string, relation string, confidence double, discovered_by string, event_time long, valid_to long, task_tag string, outcome_polarity string")
    meta = spark.createDataFrame([], "id long, from_id string, to_id string, relation string, pattern string, confidence double, valid_to long")
    return chunks, edges, meta


def test_export_and_import(spark, tmp_path):
    chunks, edges, meta = tables(spark)
    out = f"file://{tmp_path}/export"
    jsonl.export(chunks, edges, meta, out, hide_secrets=True)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert sorted(x["type"] for x in lines) == ["chunk", "chunk", "edge", "header"] and "sk-" not in str(lines)
    new_chunks, new_edges, report = jsonl.read_export(spark, out, chunks.limit(0), edges.limit(0))
    assert tuple(report.first()) == (0, 2, 1) and new_chunks.count() == 2 and new_edges.count() == 1
    plain = f"file://{tmp_path}/plain"
    jsonl.export(chunks, edges, meta, plain)
    assert tuple(jsonl.read_export(spark, plain, chunks, edges)[2].first()) == (0, 0, 0)  # all known


def test_snapshots(spark, tmp_path):
    chunks, edges, _ = tables(spark)
    jsonl.save_snapshot({"chunks": chunks, "causal_edges": edges}, f"file://{tmp_path}/store", 1)
    back = jsonl.load_snapshot(spark, f"file://{tmp_path}/store", 1)
    assert set(back) == {"chunks", "causal_edges"} and back["causal_edges"].count() == 1


def test_a_half_written_or_repeated_snapshot_is_not_seen(spark, tmp_path):
    chunks, edges, _ = tables(spark)
    root = f"file://{tmp_path}/store"
    jsonl.save_snapshot({"chunks": chunks}, root, 1)
    bad = F.udf(lambda x: 1 // 0, "string")("text")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        jsonl.save_snapshot({"chunks": chunks.limit(1), "causal_edges": chunks.withColumn("relation", bad)}, root, 2)
    assert jsonl.load_snapshot(spark, root)["chunks"].count() == 3  # still the first version
    with pytest.raises(commits.Conflict):
        jsonl.save_snapshot({"chunks": chunks.limit(1)}, root, 1)
    assert jsonl.load_snapshot(spark, root, 1)["chunks"].count() == 3


def test_stream_appends_each_turn_once(spark, tmp_path):
    schema = "id string, session_id long, event_ts timestamp, task_tag string, text string"
    rows = spark.sql("select * from values ('a', 1L, timestamp'2025-01-01 00:00:00', 't', 'x'), ('a', 1L, timestamp'2025-01-01 00:00:00', 't', 'x'), ('b', 1L, timestamp'2025-01-01 00:01:00', 't', 'y') as v(id, session_id, event_ts, task_tag, text)")
    rows.write.parquet(f"{tmp_path}/log")
    stream = ingest.turns(spark, f"{tmp_path}/log", rows.schema)
    assert schema and stream.isStreaming
    q = ingest.start(stream, f"{tmp_path}/ck", ingest.append_batches(f"{tmp_path}/out"), once=True)
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    windows = ingest.activity(rows).collect()
    assert [r.turns for r in windows] == [3]
    assert [r.turns for r in ingest.sessions(rows).collect()] == [3]


def test_counts_over_streams(spark, tmp_path):
    def run(rows, build, mode):
        path = f"{tmp_path}/{build.__name__}"
        rows.write.parquet(f"{path}/in")
        q = build(spark.readStream.schema(rows.schema).parquet(f"{path}/in")).writeStream.outputMode(mode).format("memory").queryName(build.__name__).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(build.__name__).collect()

    together = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "a"],)], "ids array<string>")
    assert {(r.from_id, r.to_id): (r.n, round(r.weight, 2)) for r in run(together, ingest.pair_counts, "update")} == {("a", "b"): (2, 0.25), ("a", "c"): (1, 0.2), ("b", "c"): (1, 0.2), ("b", "a"): (1, 0.2)}
    seen = spark.sql("select * from values (1, timestamp'2025-01-01 00:00:00'), (1, timestamp'2025-01-02 00:00:00'), (2, timestamp'2025-04-01 00:00:00') as v(id, event_ts)")
    assert {r.id: (r.n, r["last"].day) for r in run(seen, ingest.access_counts, "update")} == {1: (2, 2), 2: (1, 1)}
    assert sorted((r.id, r.n, r.dormant) for r in run(seen, ingest.dormancy, "append")) == [(1, 2, False), (1, 2, True), (2, 1, False)]


def test_conversation_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}')
    (tmp_path / "b.json").write_text('[{"speaker": "Ann", "text": "no"}]')
    assert sorted((r.place, r.speaker, r.text) for r in sessions.conversations(spark, str(tmp_path)).collect()) == [(0, "Ann", "no"), (0, "user", "hi"), (1, "assistant", "yes")]


def test_conversations_of_a_line_each(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"messages": [{"role": "user", "content": "hi\\nthere"}, {"role": "assistant", "content": "yes"}]}\n\n {"turns": [{"speaker": "Bo", "text": "a\u2028b"}]}\nno json\n')
    (tmp_path / "b.jsonl").write_text('[{"speaker": "Ann", "text": "no"}]')
    rows = sessions.conversations(spark, str(tmp_path), lines=True).collect()
    assert sorted((r.session[-7:], r.line, r.place, r.speaker, r.text) for r in rows) == [("a.jsonl", 0, 0, "user", "hi\nthere"), ("a.jsonl", 0, 1, "assistant", "yes"), ("a.jsonl", 2, 0, "Bo", "a\u2028b"), ("b.jsonl", 0, 0, "Ann", "no")]


def test_written_conversations_share_the_files_of_a_session(spark, tmp_path, monkeypatch):
    from tracewell import catalogue

    monkeypatch.setattr(catalogue, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    spark.range(9).selectExpr("1000 * id + 7 as conv_id", "0L as turn", "'user' as role", "concat('text ', id) as text").write.parquet(f"{tmp_path}/in/conversations.parquet")
    rows = catalogue.queries()["read_conversations"](spark, f"{tmp_path}/in").collect()
    assert sorted((r.session, r.place, r.speaker, r.text) for r in rows) == [(7, 0, "user", f"text {i}") for i in range(9)]
    assert len(list((tmp_path / "conversations").glob("*/*.txt"))) == 1


def test_lines_of_a_log_in_splits_keep_their_order(spark, tmp_path):
    text = "".join(f'{{"type": "message", "text": "{i:04d}{"x" * 100}"}}\n' for i in range(500))
    (tmp_path / "log.jsonl").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = sessions.calls(spark, str(tmp_path)).texts.orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(r.text[:4]) for r in rows] == list(range(500)) and len({r.line for r in rows}) == 500


def test_reasoned_decisions_and_new_verdicts(spark):
    from tracewell.operators import dml

    texts = spark.createDataFrame([("s", 1, "x" * 100), ("s", 2, "y" * 100), ("s", 3, "z" * 100)], "session string, line long, text string")
    find = lambda t: t.select("session", "line", F.substring("text", 1, 1).alias("decision"), F.lit("as it is").alias("reasoning"))
    judge = lambda d: d.withColumn("confidence", F.when(F.col("decision") == "x", 0.9).when(F.col("decision") == "y", 0.2))
    got = sessions.reasoned(sessions.Session(None, None, None, texts), find, judge).collect()
    assert sorted((r.decision, r.confidence, r.task_tag) for r in got) == [("x", 0.9, "reasoning"), ("z", 0.5, "reasoning")]
    edges = spark.createDataFrame([(1, "a", 0.5, "agent", None), (2, "a", 0.5, "agent", 9), (3, "b", 0.5, "agent", None)], "id long, from_id string, confidence double, discovered_by string, valid_to long")
    new = dml.rejudge(edges, spark.createDataFrame([("a", 1.5, "user_feedback")], "from_id string, confidence double, discovered_by string"))
    assert sorted((r.id, r.confidence, r.discovered_by) for r in new.collect()) == [(1, 1.0, "user_feedback"), (2, 0.5, "agent"), (3, 0.5, "agent")]


def test_scopes(spark):
    from tracewell.plans.memory import valid_scope

    rows = spark.createDataFrame([("user",), ("tenant:3",), ("tenant:",), (":x",), ("a:b:c",), ("other",)], "scope string")
    assert [r[0] for r in rows.select(valid_scope(F.col("scope"))).collect()] == [True, True, False, False, False, False]


def test_facade(spark):
    chunks, edges, meta = tables(spark)
    facts = spark.createDataFrame([(1, "deploy_target", "server", "user", 0.9, 1, None)], "id long, key string, value string, scope string, confidence double, updated_at long, valid_to long")
    m = Memory(chunks, edges, meta, facts)
    q = spark.createDataFrame([(0, "deploy server")], "qid long, query string")
    assert {r.id for r in m.dual_pool(q).collect()} == {"causal:1", "fact:1"}
    assert [(r.id, r.rank) for r in m.unified(q).orderBy("rank").collect()] == [("fact:1", 1), ("causal:1", 2)]
    assert [r.label for r in m.intervene(q).collect()] == ["DANGER"]
    assert m.compare("deploy server", "nothing").first().verdict == "insufficient"
    asked = spark.createDataFrame([(0, "how many deploy server runs"), (1, "unheard of"), (2, "")], "qid long, query string")
    assert [(r.qid, r.id) for r in m.search_multi_pass(asked, 100).collect()] == [(0, "1")]
    assert sorted((r.qid, r.id) for r in m.search_causal(asked).collect()) == [(0, "1"), (2, "1")]
    assert sorted((r.qid, r.id) for r in m.search_facts(asked).collect()) == [(0, "1"), (1, "1"), (2, "1")]
    why = spark.createDataFrame([(0, "why did the deploy server fail"), (1, "what is the deploy server"), (2, "zzz")], "qid long, query string")
    shown = {(r.qid, r.id): r.shown for r in m.search_memory(why).collect()}
    assert shown == {(0, "fact:1"): False, (0, "causal:1"): True, (1, "fact:1"): True, (1, "causal:1"): False}
    assert m.search_memory(why, scope="agent").filter("id like 'fact:%'").count() == 0
    vectors = Memory(chunks, edges, meta, facts, spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>"), spark.createDataFrame([(1, [0.0, 1.0])], "id long, vector array<float>"))
    near = spark.createDataFrame([(0, "zzz", [1.0, 0.1])], "qid long, query string, query_vector array<float>")
    assert [r.id for r in vectors.causal_semantic(near, 3).collect()] == ["1"] and [r.id for r in vectors.search_facts(near).collect()] == ["1"]
    assert {r.id for r in vectors.search_memory(near).collect()} == {"causal:1", "fact:1"}
    assert [r.id for r in m.lesson("deploy").collect()] == [1]
    assert jsonl.pages(m.entries).filter(F.col("node") == "build failed").first().page.endswith("deploy server sk-abcdefgh123")


def test_vault_has_every_node_fact_and_connection(spark, monkeypatch):
    monkeypatch.setattr(wiki, "CONNECTIONS", 3)
    rows = [(i, "hub", f"n{i}", "deploy: the hub", f"outcome {i}", "caused" if i % 2 else "prevented", i / 10, "t" if i else None, "agent") for i in range(8)]
    entries = spark.createDataFrame(rows, "id long, from_id string, to_id string, decision string, outcome string, relation string, confidence double, task_tag string, discovered_by string")
    facts = spark.createDataFrame([(1, "editor", "vim", "user", 0.8, "agent", None), (2, "shell", "vim", "user", 0.8, None, None), (3, "old", "x", "user", 0.8, "agent", 5)], "id long, key string, value string, scope string, confidence double, source string, valid_to long")
    pages = {r.path: r.page for r in wiki.vault(entries, facts).collect()}
    hub = sorted(p for p in pages if p.startswith("deploy-the-hub-"))
    assert len(hub) == 3 and len(pages) == 3 + 8 + 2 + 1
    lines = [x for p in sorted(hub, key=lambda p: (len(p), p)) for x in pages[p].splitlines() if x.startswith("- **")]
    assert [x.split("|")[1][:9] for x in lines] == [f"outcome {i}" for i in range(7, -1, -1)]
    assert lines[0].startswith("- **caused** → [[outcome-7-") and lines[0].endswith("]] (70% confidence)") and lines[1].startswith("- **prevented** ⊣")
    links = {x.split("[[")[1].split("|")[0] + ".md" for p in pages.values() for x in p.splitlines() if "[[" in x}
    assert links <= set(pages)
    assert pages["README.md"].startswith("# Vault\n\n8 causal edges across 9 nodes.\n2 facts.")
    assert sum(p.startswith("Facts/vim-") for p in pages) == 2
    assert "| Task | — |" in next(pages[p] for p in pages if p.startswith("outcome-0-"))
