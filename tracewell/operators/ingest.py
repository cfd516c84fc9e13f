"""Turns and distilled items into the store: batches in, new tables out."""

from __future__ import annotations

import json
import re
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import text as tx
from tracewell.operators import dml
from tracewell.schema import entries
from tracewell.session import materialise

# Kinds of items, their confidence, relations of causal ones, and names under which replies give fields.
KINDS = ["fact", "preference", "lesson", "event", "causal"]
SURE_KINDS, SURE, USUAL = ["lesson", "causal"], 0.7, 0.6
RELATIONS = ["caused", "enabled", "prevented"]
KIND_NAMES, TEXT_NAMES, LIST_NAMES = ["kind", "type"], ["text", "description", "content"], ["items", "memories", "memory"]

ITEM = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ["kind", "text", "date", "supersedes", "causal_relation", "decision"]]))


def raw_turns(turns: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, edges) of turns (session, place, speaker, text): a node a turn, and an edge that claims nothing from each to the next.

    Places count from 0 within a session; of repeated ones the smallest text stays. Null speakers and texts
    count as empty. An edge's id is a hash of its ends.
    """
    node = lambda place: F.concat(F.lit("raw:"), F.col("session").cast("string"), F.lit(":"), place.cast("string"))
    said = F.concat(F.lit("["), "session", F.lit("] "), F.coalesce("speaker", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    chunks = turns.groupBy("session", "place").agg(F.min(said).alias("text")).select(node(F.col("place")).alias("id"), "text", F.lit(now).cast("long").alias("created_at"), F.lit(0.5).alias("q_value"), "session", "place")
    later = chunks.filter("place > 0").select(node(F.col("place") - 1).alias("from_id"), F.col("id").alias("to_id"))
    at = F.lit(now).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    edges = later.select(F.xxhash64("from_id", "to_id").alias("id"), "from_id", "to_id", F.lit("no_effect").alias("relation"), F.lit(0.4).alias("confidence"), F.lit("temporal").alias("discovered_by"), at.alias("event_time"), at.alias("discovered_at"),
                         none("string").alias("task_tag"), none("string").alias("outcome_polarity"), none("long").alias("valid_to"), none("long").alias("superseded_by"), F.lit(0).cast("long").alias("access_count"))
    return chunks.drop("session", "place"), edges


def _day(value) -> str | None:
    try:
        return date.fromisoformat(value.strip()).isoformat() if re.fullmatch(r"\d{4}-\d\d-\d\d", value.strip()) else None
    except (AttributeError, ValueError):
        return None


def _whole_objects(text: str) -> list:
    """The JSON objects among the outermost {...} of a text that is no JSON as a whole."""
    found, depth, begin = [], 0, 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', text, re.DOTALL):
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    found.append(json.loads(text[begin : m.end()]))
                except ValueError:
                    continue
    return found


def parse_items(reply: str | None, fallback_date: str | None = None) -> list[dict]:
    """The items of a language model's reply: a list, an object that holds one, one item, or what is whole of a broken reply.

    Items without text are left out; unknown kinds are facts; a causal relation makes an item causal.
    """
    text = (reply or "").strip()
    if text.startswith("```"):
        text = re.sub(r"^```(?:json)?\s*|\s*```$", "", text)
    try:
        held = json.loads(text)
    except (ValueError, RecursionError):
        held = _whole_objects(text)
    if isinstance(held, dict):
        held = next((held[k] for k in LIST_NAMES if isinstance(held.get(k), list)), [held])
    string = lambda v: v.strip() if isinstance(v, str) else ""
    out = []
    for x in held if isinstance(held, list) else []:
        if not isinstance(x, dict):
            continue
        said = string(next((x[k] for k in TEXT_NAMES if k in x), None))
        kind = string(next((x[k] for k in KIND_NAMES if k in x), None)).lower()
        relation = string(x.get("causal_relation")).lower()
        relation = relation if relation in RELATIONS else None
        hint = string(x.get("supersedes"))
        if said:
            out.append({"kind": "causal" if relation else kind if kind in KINDS else "fact", "text": said, "date": _day(x.get("date")) or _day(fallback_date), "supersedes": hint if hint not in ("", "null") else None, "causal_relation": relation, "decision": x.get("decision") if isinstance(x.get("decision"), str) and x["decision"] else None})
    return out


@F.pandas_udf(ITEM)
def items_of(reply: pd.Series, fallback_date: pd.Series) -> pd.Series:
    """parse_items over columns: replies need a parser that bears broken JSON, which SQL functions are not."""
    return pd.Series([parse_items(r, d) for r, d in zip(reply, fallback_date)])


def record_distilled(chunks: DataFrame, edges: DataFrame, items: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """New (chunks, edges) with items (id, kind, text, date, supersedes, causal_relation, decision, task_tag), later ids later.

    An item becomes the node "[date] text" and an edge of its id: from its decision for a causal item, else
    from itself. An item whose node is there, or of an earlier id in the batch, changes nothing. A hint of
    what it replaces, or its own text where that takes something back, retires older edges (dml.supersede_by_hint),
    each by the first item that does, and a node says that the old text no longer holds; its edge has the
    negative of the retired edge's id. The batch, the valid edges and the retired ones are written to the
    shared folder, as each is used several times; callers write both tables before the next batch.
    """
    day = F.coalesce("date", F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd"))
    node = lambda text: F.concat(F.lit("distill:"), F.md5(text))
    new = items.withColumns({"_day": day, "_text": F.concat(F.lit("["), day, F.lit("] "), F.trim("text"))})
    first = new.groupBy("_text").agg(F.min("id").alias("id"))
    known = chunks.filter("id like 'distill:%'").select(F.col("text").alias("_text"))
    new = new.join(first, ["_text", "id"], "left_semi").join(known, "_text", "left_anti").dropDuplicates(["id"])
    causal = F.col("kind") == "causal"
    new = new.withColumns({"_at": F.unix_timestamp(F.to_timestamp("_day", "yyyy-MM-dd")), "_from": F.when(causal, F.coalesce("decision", F.lit("unknown action"))).otherwise(F.col("_text"))})
    new = materialise(new, "distilled")

    def edge(ids, source, target, relation, confidence):
        none = lambda kind: F.lit(None).cast(kind)
        return [ids.alias("id"), node(source).alias("from_id"), node(target).alias("to_id"), relation.alias("relation"), confidence.alias("confidence"), F.lit("distill").alias("discovered_by"), F.col("_at").alias("event_time"), F.lit(now).cast("long").alias("discovered_at"),
                none("long").alias("valid_to"), F.col("task_tag"), F.lit(0).cast("long").alias("access_count"), none("string").alias("outcome_polarity"), none("long").alias("superseded_by")]

    def with_nodes(chunks, rows, *texts):
        wanted = rows.select(F.explode(F.array(*texts)).alias("text"), F.col("_at").alias("created_at")).groupBy("text").agg(F.min("created_at").alias("created_at"))
        wanted = wanted.select(node(F.col("text")).alias("id"), "text", "created_at", F.lit(0.5).alias("q_value")).join(chunks.select("id"), "id", "left_anti")
        return chunks.unionByName(wanted, allowMissingColumns=True)

    relation = F.when(causal, F.coalesce("causal_relation", F.lit("caused"))).otherwise(F.lit("caused"))
    confidence = F.when(F.col("kind").isin(SURE_KINDS), SURE).otherwise(USUAL)
    chunks = with_nodes(chunks, new, "_from", "_text")
    edges = edges.unionByName(new.select(*edge(F.col("id"), F.col("_from"), F.col("_text"), relation, confidence)), allowMissingColumns=True)

    hint = F.coalesce("supersedes", F.when(tx.is_retraction(F.col("text")), F.col("text")))
    hints = new.filter(hint.isNotNull()).select(F.col("id").alias("hint"), hint.alias("text"), "task_tag", F.col("_at").alias("event_time"))
    old = materialise(entries(edges, chunks).select("id", "decision", "task_tag", "event_time", "valid_to"), "distilled-entries")
    hit = dml.supersede_by_hint(old, hints).filter("id < hint").groupBy("id").agg(F.min("hint").alias("hint"))
    by = new.select(F.col("id").alias("hint"), "_day", "_at", "task_tag")
    gone = hit.join(old.select("id", "decision"), "id").join(by, "hint").withColumn("_text", F.concat(F.lit("["), "_day", F.lit("] Cancelled/superseded: "), F.substring("decision", 1, 200)))
    gone = materialise(gone, "distilled-gone")
    hit = gone.select("id", "hint")
    retired = edges.join(hit, "id", "left").withColumns({"valid_to": F.when(F.col("hint").isNotNull(), F.lit(now)).otherwise(F.col("valid_to")), "superseded_by": F.coalesce("hint", "superseded_by")}).drop("hint")
    void = gone.select(*edge(-F.col("id"), F.col("_text"), F.col("_text"), F.lit("caused"), F.lit(USUAL)))
    return with_nodes(chunks, gone, "_text"), retired.unionByName(void, allowMissingColumns=True)
