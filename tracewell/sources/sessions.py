"""Readers of agents' session logs: four JSONL layouts into one set of tables.

Each reader gives Session(decisions, results, events, texts):
decisions (session, line, place, call, tool, arguments), results (session, line, call, content),
events (session, line, tool, outcome, ts), texts (session, line, text) of assistants, 100 bytes or more.
Lines that are no JSON are left out. A session is the file a line came from, or its folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import calls as calls_of

#: Fixed value: the confidence under which a reasoned decision does not count.
LEAST = 0.3


@dataclass
class Session:
    decisions: DataFrame
    results: DataFrame
    events: DataFrame
    texts: DataFrame


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(session, line, value): a number orders a line within its file.

    Large files are read in splits; a line's number is where its split begins plus the lines before it there, so
    numbers rise along a file and are not those of an editor beyond the first split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    line = F.col("start") + F.col("n") - F.min("n").over(Window.partitionBy("session", "start"))
    return raw.select("session", line.cast("long").alias("line"), "value")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(session, line, j) of the lines that are JSON with a type."""
    return _numbered(spark, path).select("session", "line", F.from_json("value", schema).alias("j")).filter("j is not null and j.type is not null")


def _texts(rows: DataFrame, text: Column) -> DataFrame:
    return rows.select("session", "line", text.alias("text")).filter(F.octet_length("text") >= 100)


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


_CALLS = "array<struct<id: string, name: string, arguments: string>>"


def directory(spark: SparkSession, path: str) -> Session:
    """chat_history.jsonl with tool_calls and tool_result lines, and events.jsonl with tool_completed lines."""
    folder = F.regexp_replace("session", "/[^/]*$", "")
    chat = _lines(spark, f"{path}/chat_history.jsonl", f"type string, content string, tool_calls {_CALLS}, tool_call_id string").withColumn("session", folder)
    events = _lines(spark, f"{path}/events.jsonl", "type string, tool_name string, outcome string, ts string").withColumn("session", folder)
    calls = chat.filter("j.type = 'assistant'").select("session", "line", F.posexplode("j.tool_calls").alias("place", "c"))
    return Session(
        calls.select("session", "line", "place", F.col("c.id").alias("call"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments")),
        chat.filter("j.type = 'tool_result'").select("session", "line", F.col("j.tool_call_id").alias("call"), F.col("j.content").alias("content")),
        events.filter("j.type = 'tool_completed'").select("session", "line", F.col("j.tool_name").alias("tool"), F.col("j.outcome").alias("outcome"), F.col("j.ts").alias("ts")),
        _texts(chat.filter("j.type = 'assistant'"), F.col("j.content")),
    )


_BLOCKS = "array<struct<type: string, id: string, name: string, input: string, tool_use_id: string, content: string, text: string>>"


def blocks(spark: SparkSession, path: str) -> Session:
    """One file with messages of nested blocks: tool_use, tool_result, text."""
    rows = _lines(spark, path, f"type string, message struct<content: {_BLOCKS}>").select("session", "line", F.posexplode("j.message.content").alias("place", "b"))
    return Session(
        rows.filter("b.type = 'tool_use'").select("session", "line", "place", F.col("b.id").alias("call"), F.col("b.name").alias("tool"), F.col("b.input").alias("arguments")),
        rows.filter("b.type = 'tool_result'").select("session", "line", F.col("b.tool_use_id").alias("call"), F.col("b.content").alias("content")),
        _nothing(spark, "session string, line long, tool string, outcome string, ts string"),
        _texts(rows.filter("b.type = 'text'"), F.col("b.text")),
    )


def positional(spark: SparkSession, path: str) -> Session:
    """Tool results without ids: the k-th result after an assistant message answers its k-th call."""
    rows = _lines(spark, path, f"type string, content string, toolCalls {_CALLS}")
    w = Window.partitionBy("session").orderBy("line")
    rows = rows.withColumn("turn", F.last(F.when(F.col("j.type") == "assistant", F.col("line")), ignorenulls=True).over(w))
    calls = rows.filter("j.type = 'assistant'").select("session", "line", F.posexplode("j.toolCalls").alias("k", "c"))
    key = lambda turn, k: F.concat_ws(":", turn, k)
    answers = rows.filter("j.type = 'toolResult'").withColumn("k", F.row_number().over(Window.partitionBy("session", "turn").orderBy("line")) - 1)
    return Session(
        calls.select("session", "line", F.col("k").alias("place"), key(F.col("line"), F.col("k")).alias("call"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments")),
        answers.select("session", "line", key(F.col("turn"), F.col("k")).alias("call"), F.col("j.content").alias("content")),
        _nothing(spark, "session string, line long, tool string, outcome string, ts string"),
        _texts(rows.filter("j.type = 'assistant'"), F.col("j.content")),
    )


def calls(spark: SparkSession, path: str) -> Session:
    """A line per function call and per output, joined by call_id; an exit code other than 0 makes an outcome a failure."""
    rows = _lines(spark, path, "type string, call_id string, name string, arguments string, output string, text string")
    code = F.regexp_extract("j.output", r"exited with code (\d+)", 1)
    return Session(
        rows.filter("j.type = 'function_call'").select("session", "line", F.lit(0).alias("place"), F.col("j.call_id").alias("call"), F.col("j.name").alias("tool"), F.col("j.arguments").alias("arguments")),
        rows.filter("j.type = 'function_call_output'").select("session", "line", F.col("j.call_id").alias("call"), F.when((code != "") & (code != "0"), F.concat(F.lit("Process exited with non-zero: "), "j.output")).otherwise(F.col("j.output")).alias("content")),
        _nothing(spark, "session string, line long, tool string, outcome string, ts string"),
        _texts(rows.filter("j.type = 'message'"), F.col("j.text")),
    )


#: Readers by the names that callers use.
PARSERS = {"directory": directory, "blocks": blocks, "positional": positional, "calls": calls}


def conversations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(session, place, speaker, text) of JSON documents that hold whole conversations: an array of messages, or an object with one under messages or turns.

    A message has a role or speaker, and its text under content or text. A document is a file; or, with lines, a line of a
    file that has many, which costs no file for each: rows then have the line too, and the session is their file.
    """
    message = "array<struct<role: string, speaker: string, content: string, text: string>>"
    raw = _numbered(spark, path) if lines else spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("session"))
    raw = raw.withColumn("value", F.trim("value"))
    held = F.from_json("value", f"struct<messages: {message}, turns: {message}>")
    messages = F.when(F.col("value").startswith("["), F.from_json("value", message)).otherwise(F.coalesce(held["messages"], held["turns"]))
    of = ["session", "line"] if lines else ["session"]
    rows = raw.select(*of, F.posexplode(messages).alias("place", "m"))
    return rows.select(*of, "place", F.coalesce("m.role", "m.speaker").alias("speaker"), F.coalesce("m.content", "m.text").alias("text"))


def reasoned(session: Session, find: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(session, line, decision, outcome, relation, confidence, discovered_by, task_tag): decisions that long texts of assistants give reasons for.

    find maps texts (session, line, text) to rows (session, line, decision, reasoning), judge adds confidence to
    those; both are a caller's, as they ask a language model. Without a verdict it is 0.5; under LEAST they are dropped.
    """
    rows = judge(find(session.texts)).withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).filter(F.col("confidence") >= LEAST)
    return rows.select("session", "line", "decision", F.col("reasoning").alias("outcome"), F.lit("caused").alias("relation"), "confidence", F.lit("llm_inferred").alias("discovered_by"), F.lit("reasoning").alias("task_tag"))


def extract(session: Session) -> DataFrame:
    """(session, line, tool, decision, outcome, failed, relation, confidence, source, task_tag, at): calls worth keeping with what came of them.

    Calls that change state always count, those that read only where they clearly failed, others never, and
    none without a result; of several results of a call the last counts. The k-th event of a tool belongs to
    its k-th call kept; its time is the edge's (else null, for the caller to fill).
    """
    last = session.results.groupBy("session", "call").agg(F.max_by("content", "line").alias("content"))
    rows = session.decisions.join(last, ["session", "call"]).filter(calls_of.worthy(F.col("tool"), F.col("content")))
    kth = lambda *order: F.row_number().over(Window.partitionBy("session", "tool").orderBy(*order))
    queue = session.events.select("session", "tool", kth("line").alias("k"), F.col("outcome").alias("event"), "ts")
    rows = rows.withColumn("k", kth("line", "place", "call")).join(queue, ["session", "tool", "k"], "left")
    rows = calls_of.with_grade(rows, calls_of.decision(F.col("tool"), F.col("arguments")), F.col("content"), F.col("event"))
    failed = calls_of.clear_failure(F.col("content")) | calls_of.has_any(F.col("content"), calls_of.FAILURES) | F.coalesce(F.col("event").isin(calls_of.FAILED_EVENTS), F.lit(False))
    return rows.select("session", "line", "tool", "decision", F.substring("content", 1, 200).alias("outcome"), failed.alias("failed"), F.lit("caused").alias("relation"), "confidence", "source",
                       calls_of.task_tag(F.col("tool"), F.col("arguments")).alias("task_tag"), F.unix_timestamp(F.try_to_timestamp("ts")).alias("at"))
