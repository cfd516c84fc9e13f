"""Changes to the store as pure functions: tables and a batch in, new tables out; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.functions.hashing import signature, unlike
from tracewell.operators import alike
from tracewell.operators.nearest import near
from tracewell.schema import ensure_schema
from tracewell.session import materialise

#: Similarity at which decisions count as the same, and how far a hint has to cover a text.
SAME_DECISION, MIN_SHARED, MIN_CONTAINMENT = 0.85, 2, 0.5
#: Pairs of hints and texts of their tasks that are looked up by words, at most; texts and hints of a block where there are more.
HINT_PAIRS, HINT_BLOCK = 10_000_000, 1 << 14


def chunk_id(text: Column) -> Column:
    """Equal texts have one node: the id is a hash of the text."""
    return F.concat(F.lit("m"), F.md5(text))


def add_chunks(chunks: DataFrame, texts: DataFrame, now: int) -> DataFrame:
    """chunks with a row for each new text (text); texts already there keep their node."""
    new = texts.select("text").distinct().join(chunks.select("text"), "text", "left_anti")
    return chunks.unionByName(new.select(chunk_id(F.col("text")).alias("id"), "text", F.lit(now).cast("long").alias("created_at"), F.lit(0.5).alias("q_value")), allowMissingColumns=True)


def record_decisions(chunks: DataFrame, edges: DataFrame, batch: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """New (chunks, edges) with a batch (id, decision, outcome, relation, confidence, event_time, task_tag, outcome_polarity).

    First, valid failures are retired whose decision text a success in the batch has; then the batch is appended.
    """
    texts = batch.select(F.explode(F.array("decision", "outcome")).alias("text"))
    all_chunks = add_chunks(chunks, texts, now)
    at = all_chunks.select("id", "text")
    new = batch.join(at.select(F.col("id").alias("from_id"), F.col("text").alias("decision")), "decision").join(at.select(F.col("id").alias("to_id"), F.col("text").alias("outcome")), "outcome")
    good = new.filter(F.coalesce(tx.effective_polarity(F.col("outcome_polarity"), F.col("outcome")), F.lit(False))).select("from_id").distinct()
    ends = at.select(F.col("id").alias("to_id"), F.col("text").alias("_outcome"))
    falsified = edges.filter("valid_to is null").join(good, "from_id", "left_semi").join(ends, "to_id").filter(~tx.effective_polarity(F.col("outcome_polarity"), F.col("_outcome"))).select("id")
    kept = invalidate(edges, falsified, now)
    rows = new.select("id", "from_id", "to_id", "relation", "confidence", F.lit("agent").alias("discovered_by"), "event_time", F.lit(now).cast("long").alias("discovered_at"), "task_tag", "outcome_polarity", F.lit(0).cast("long").alias("access_count"))
    return all_chunks, kept.unionByName(rows, allowMissingColumns=True)


def falsified_pairs(entries: DataFrame) -> DataFrame:
    """(old, new): edges of one decision whose outcomes contradict each other, the older id first."""
    p = tx.effective_polarity(F.col("outcome_polarity"), F.col("outcome"))
    side = lambda s: entries.select("from_id", F.col("id").alias(s), F.col("outcome").alias(f"o_{s}"), p.alias(f"p_{s}"))
    rows = side("old").join(side("new"), "from_id").filter("old < new and o_old <> o_new")
    return rows.filter(tx.outcomes_contradict(F.col("p_old"), F.col("p_new"))).select("old", "new")


def semantic_contradictions(entries: DataFrame, vectors: DataFrame, batch: DataFrame) -> DataFrame:
    """(old, new): valid failures with a decision close to that of a success in the batch (id, decision, polarity, vector); vectors (id, vector)."""
    failed = entries.filter(~tx.effective_polarity(F.col("outcome_polarity"), F.col("outcome"))).join(vectors, "id").select(F.col("id").alias("old"), F.col("decision").alias("_d"), "vector")
    good = batch.filter("polarity").select(F.col("id").alias("new"), F.col("decision").alias("_said"), F.col("vector").alias("query_vector"))
    return near(failed, good, "old", "new", least=SAME_DECISION).filter(F.col("_d") != F.col("_said")).select("old", "new")


def invalidate(edges: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Edges with those of ids (id) no longer valid from now on."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return edges.join(hit, "id", "left").withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), F.lit(now).cast("long")).otherwise(F.col("valid_to"))).drop("_hit").select(*edges.columns)


def restore(edges: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    none = F.lit(None).cast("long")
    return edges.join(hit, "id", "left").withColumns({"valid_to": F.when(F.col("_hit"), none).otherwise(F.col("valid_to")), "superseded_by": F.when(F.col("_hit"), none).otherwise(F.col("superseded_by"))}).drop("_hit").select(*edges.columns)


def rejudge(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Valid edges of the decisions in verdicts (from_id, confidence, discovered_by) with the confidence, held to [0, 1], and source given there; of repeated decisions the surest verdict."""
    new = verdicts.groupBy("from_id").agg(F.max(F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")).alias("confidence"), "discovered_by")).alias("_v"))
    hit = F.col("_v").isNotNull() & F.col("valid_to").isNull()
    changed = {c: F.when(hit, F.col(f"_v.{c}")).otherwise(F.col(c)) for c in ("confidence", "discovered_by")}
    return edges.join(new, "from_id", "left").withColumns(changed).select(*edges.columns)


def annotate_superseded(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with superseded_by set from pairs (old, new), the smallest new of each; they stay valid."""
    new = pairs.groupBy(F.col("old").alias("id")).agg(F.min("new").alias("_new"))
    return edges.join(new, "id", "left").withColumn("superseded_by", F.coalesce("_new", "superseded_by")).drop("_new").select(*edges.columns)


def supersede_by_hint(entries: DataFrame, hints: DataFrame) -> DataFrame:
    """(id, hint): valid edges that a hint (hint, text, task_tag, event_time) retires.

    Not later than the hint, of its task, no retraction themselves, without a date in common with it,
    and sharing two words or more, digits left out, that make half of the smaller text. Up to HINT_PAIRS pairs of a task's texts (counted) meet on their
    words, and those whose signatures differ too much to share so many are refused where they meet, before they are counted. More meet in blocks, and no pair is shuffled.
    """
    words = lambda c: F.array_distinct(F.filter(tx.tokens(c), lambda t: ~F.regexp_like(t, F.lit("^[0-9]+$"))))
    old = entries.filter("valid_to is null").select("id", "task_tag", "event_time", F.col("decision").alias("_text"), words(F.col("decision")).alias("_w"), tx.date_tokens(F.col("decision")).alias("_dates"))
    old = old.filter(~tx.is_retraction(F.col("_text")))
    new = hints.select("hint", F.col("task_tag").alias("_tag"), F.col("event_time").alias("_at"), words(F.col("text")).alias("_hw"), tx.date_tokens(F.col("text")).alias("_hd"))
    old, new = materialise(old.drop("_text"), "hint-old"), materialise(new, "hint-new")  # words are taken once, and signatures once a text
    sizes = old.groupBy("task_tag").count().join(new.groupBy("_tag").agg(F.count(F.lit(1)).alias("_c")), F.col("task_tag").eqNullSafe(F.col("_tag"))).drop("_tag")
    sizes = materialise(sizes.withColumnsRenamed({"task_tag": "_of", "count": "_n"}), "hint-sizes")
    if (sizes.agg(F.sum(F.col("_n") * F.col("_c"))).first()[0] or 0) > HINT_PAIRS:
        return _hinted_in_blocks(old, new, sizes)
    signed_old = materialise(old.select("id", "task_tag", "event_time", "_w", F.size("_w").alias("_n"), *signature(F.col("_w"), "s")), "hint-old-signed")
    signed_new = materialise(new.select("hint", "_tag", "_at", "_hw", F.size("_hw").alias("_hn"), *signature(F.col("_hw"), "h")), "hint-new-signed")
    held, asked = signed_old.withColumn("_t", F.explode("_w")).drop("_w"), signed_new.withColumn("_t", F.explode("_hw")).drop("_hw")
    needed = F.greatest(F.lit(MIN_SHARED), MIN_CONTAINMENT * F.least("_n", "_hn"))
    met = held.join(asked, (held["_t"] == asked["_t"]) & F.col("task_tag").eqNullSafe(F.col("_tag")) & (F.col("event_time") <= F.col("_at")))
    near = met.filter(unlike("s", "h") <= F.col("_n") + F.col("_hn") - 2 * needed).groupBy("id", "hint").agg(F.count(F.lit(1)).alias("_shared")).filter(F.col("_shared") >= MIN_SHARED)
    rows = near.join(old, "id").join(new, "hint")
    return rows.filter(F.col("task_tag").eqNullSafe(F.col("_tag")) & (F.col("event_time") <= F.col("_at")) & ~F.arrays_overlap("_dates", "_hd") & (F.col("_shared") >= MIN_CONTAINMENT * F.least(F.size("_w"), F.size("_hw")))).select("id", "hint")


def _hinted_in_blocks(old: DataFrame, new: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, hint) of old (id, task_tag, event_time, _w, _dates) and new (hint, _tag, _at, _hw, _hd), as supersede_by_hint says; sizes (_of, _n, _c): how many of both a task has.

    Each task's texts are dealt into blocks by a hash of their ids, and two blocks meet in a task, which counts the words that pairs share.
    """
    parts = sizes.select("_of", F.ceil(F.col("_n") / HINT_BLOCK).cast("int").alias("_po"), F.ceil(F.col("_c") / HINT_BLOCK).cast("int").alias("_ph"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    held = old.filter("event_time is not null").join(parts, F.col("task_tag").eqNullSafe(F.col("_of"))).withColumn("_j", every("_ph"))
    held = held.select("_of", block("id", "_po").alias("_i"), "_j", "id", none(new, "hint"), F.col("event_time").cast("long").alias("at"), F.col("_w").alias("words"), F.col("_dates").alias("dates"), F.lit(True).alias("old"))
    asked = new.filter("_at is not null").join(parts, F.col("_tag").eqNullSafe(F.col("_of"))).withColumn("_i", every("_po"))
    asked = asked.select("_of", "_i", block("hint", "_ph").alias("_j"), none(old, "id"), "hint", F.col("_at").cast("long").alias("at"), F.col("_hw").alias("words"), F.col("_hd").alias("dates"), F.lit(False).alias("old"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        a, b = rows.filter(pc.invert(rows["old"])).combine_chunks(), rows.filter(rows["old"]).sort_by("at").combine_chunks()
        words = lambda t: t["words"].combine_chunks()
        na, nb = (pc.list_value_length(words(t)).to_numpy().astype(np.int64) for t in (a, b))
        if not na.any() or not nb.any():
            return
        code = pc.dictionary_encode(pa.concat_arrays([words(a).flatten(), words(b).flatten()])).indices.to_numpy().astype(np.int64) << alike.BITS
        index = code[na.sum() :] + np.repeat(np.arange(len(nb)), nb)
        index.sort()
        high = np.searchsorted(b["at"].to_numpy(), a["at"].to_numpy(), side="right")
        da, db = ([frozenset(x or ()) for x in t["dates"].to_pylist()] for t in (a, b))
        dated_a, dated_b = (np.array([bool(x) for x in d]) for d in (da, db))
        for row, first, shared in alike.counted(index, code[: na.sum()], na, np.zeros(len(na), np.int64), high):
            least = np.minimum(na[row : row + len(shared), None], nb[None, first : first + shared.shape[1]])
            i, j = np.nonzero((shared >= MIN_SHARED) & (shared >= MIN_CONTAINMENT * least))
            i, j = i + row, j + first
            both = np.flatnonzero(dated_a[i] & dated_b[j])
            same = both[[not da[x].isdisjoint(db[y]) for x, y in zip(i[both], j[both])]] if len(both) else both
            i, j = np.delete(i, same), np.delete(j, same)
            if len(i):
                yield pa.RecordBatch.from_arrays([b["id"].combine_chunks().take(pa.array(j)), a["hint"].combine_chunks().take(pa.array(i))], names=["id", "hint"])

    schema = f"id {old.schema['id'].dataType.simpleString()}, hint {new.schema['hint'].dataType.simpleString()}"
    return held.unionByName(asked).groupBy("_of", "_i", "_j").applyInArrow(meet, schema)


def upsert_facts(facts: DataFrame, batch: DataFrame, now: int, replace: bool = False) -> DataFrame:
    """Facts with a batch (id, key, value, scope, confidence, and source if any): an equal (key, value, scope) is renewed and valid again, others are added.

    All columns of the table stay, missing ones are added empty. A renewed fact keeps id and created_at; where the
    table has it several times all are renewed, and it goes by the smallest id. Of
    repeated rows in a batch the last id counts. replace: of a key and scope only the batch's last value stays
    valid: each earlier one is retired, superseded by the next, and all that the table had by the first.
    """
    facts, keys = ensure_schema(facts, "agent_facts", extra=True), ["key", "value", "scope"]
    source = F.col("source") if "source" in batch.columns else F.lit("agent")
    held = F.struct("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")).alias("confidence"), source.alias("source"))
    known = facts.groupBy(*keys).agg(F.min("id").alias("_known"))
    new = batch.groupBy(*keys).agg(F.max_by(held, "id").alias("_b")).join(known, keys, "left").withColumn("_fact", F.coalesce("_known", F.col("_b.id").cast("long")))
    order = Window.partitionBy("key", "scope").orderBy("_b.id", "value")
    new = new.withColumn("_next", F.lead("_fact").over(order) if replace else F.lit(None).cast("long"))
    at, hit = F.lit(now).cast("long"), F.col("_b").isNotNull()
    ends = F.when(F.col("_next").isNotNull(), at)
    changed = {"confidence": F.col("_b.confidence"), "source": F.col("_b.source"), "updated_at": at, "valid_to": ends, "superseded_by": F.col("_next")}
    kept = facts.join(new.drop("_known", "_fact"), keys, "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed.items()})
    if replace:
        first = new.groupBy("key", "scope").agg(F.min_by("_fact", F.struct("_b.id", "value")).alias("_first"))
        old = ~hit & F.col("_first").isNotNull() & F.col("valid_to").isNull()
        kept = kept.join(first, ["key", "scope"], "left").withColumns({"superseded_by": F.when(old, F.col("_first")).otherwise(F.col("superseded_by")), "valid_to": F.when(old, at).otherwise(F.col("valid_to"))})
    added = new.filter("_known is null").select(F.col("_fact").alias("id"), *keys, *[v.alias(c) for c, v in changed.items()], at.alias("created_at"))
    return kept.select(*facts.columns).unionByName(added, allowMissingColumns=True)


def retire_facts_by_hint(facts: DataFrame, hints: DataFrame, now: int) -> DataFrame:
    """Facts with those retired that a hint (key, scope, hint, and exclude, the id of the fact it came with) takes back.

    A fact of the same key and scope, no retraction itself, sharing MIN_SHARED distinct tokens of its value or
    more, which make MIN_CONTAINMENT of the smaller set.
    """
    words = lambda c: F.array_distinct(tx.tokens(c))
    asked = hints.select("key", "scope", words(F.col("hint")).alias("_h"), F.col("exclude").alias("_own")).filter(F.size("_h") >= MIN_SHARED)
    near = facts.filter("valid_to is null").select("id", "key", "scope", "value", words(F.col("value")).alias("_w")).filter(~tx.is_retraction(F.col("value"))).join(asked, ["key", "scope"])
    shared = F.size(F.array_intersect("_w", "_h"))
    hit = near.filter((F.col("_own").isNull() | (F.col("_own") != F.col("id"))) & (shared >= MIN_SHARED) & (shared >= MIN_CONTAINMENT * F.least(F.size("_w"), F.size("_h")))).select("id")
    return invalidate(facts, hit, now)


def upsert_meta(meta: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """Meta edges with a batch (id, from_id, to_id, relation, confidence, and pattern, strata_count, confounded, simpson where known): a valid one of the same ends and relation is renewed, others are added.

    Of repeated rows in a batch the last id counts. All columns of the table stay.
    """
    keys, at = ["from_id", "to_id", "relation"], F.lit(now).cast("long")
    more = [c for c in ("pattern", "strata_count", "confounded", "simpson") if c in batch.columns and c in meta.columns]
    new = batch.groupBy(*keys).agg(F.max_by(F.struct("id", "confidence", *more), "id").alias("_b"))
    hit = F.col("_b").isNotNull()
    renewed = {c: F.when(hit, F.col(f"_b.{c}")).otherwise(F.col(c)) for c in ("confidence", *more)}
    if "discovered_at" in meta.columns:
        renewed["discovered_at"] = F.when(hit, at).otherwise(F.col("discovered_at"))
    live = meta.filter("valid_to is null").join(new, keys, "left").withColumns(renewed)
    added = new.join(meta.filter("valid_to is null").select(*keys), keys, "left_anti").select("_b.id", *keys, *[F.col(f"_b.{c}").alias(c) for c in ("confidence", *more)], at.alias("discovered_at"), at.alias("valid_from"))
    own = [c for c in added.columns if c in meta.columns]
    return meta.filter("valid_to is not null").unionByName(live.select(*meta.columns)).unionByName(added.select(*own), allowMissingColumns=True)


def patch_polarity(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges with the outcome_polarity of a batch (id, outcome_polarity) where they have none; of repeated ids the smallest value."""
    new = batch.groupBy("id").agg(F.min("outcome_polarity").alias("_p"))
    return edges.join(new, "id", "left").withColumn("outcome_polarity", F.coalesce("outcome_polarity", "_p")).select(*edges.columns)


def put_vectors(vectors: DataFrame, batch: DataFrame) -> DataFrame:
    """Vectors with those of a batch in place of any of the same id."""
    return vectors.join(batch.select("id"), "id", "left_anti").unionByName(batch)


def add_access(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Edges with accesses from an append-only log (flush, id, at): one a flush and id, and the latest time."""
    seen = log.groupBy("id").agg(F.countDistinct("flush").alias("_n"), F.max("at").alias("_at"))
    return edges.join(seen, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "_at")}).drop("_n", "_at").select(*edges.columns)


def recurrent(queries: DataFrame, prior: DataFrame, threshold: float) -> DataFrame:
    """(id, prior, similarity): sessions (id, vector) with an earlier one at least so similar: the nearest of prior (id, vector)."""
    rows = near(prior.select(F.col("id").alias("prior"), "vector"), queries.select("id", F.col("vector").alias("query_vector")), "prior", "id", 1)
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.round("similarity", 9).desc(), "prior"))).filter("_n = 1")
    return best.filter(F.col("similarity") >= threshold).select("id", "prior", "similarity")
