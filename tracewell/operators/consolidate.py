"""Offline consolidation: each stage maps tables to tables, with the time given as now."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import dml, graph, greedy, patterns
from tracewell.operators.patterns import opposed_pairs
from tracewell.schema import ensure_schema
from tracewell.schema import entries as entries_of
from tracewell.session import materialise

DAY = 86_400


@dataclass(frozen=True)
class Config:
    """The defaults of consolidation."""

    protect_at: float = 1.0
    recent_days: int = 7
    decay_per_day: float = 0.99
    half_life_hours: tuple[tuple[str, float], ...] = (("user_feedback", 2160.0), ("llm_inferred", 2160.0), ("temporal", 168.0))
    fact_half_life_hours: float = 2160.0
    protected_divisor: float = 2.0
    boost: float = 0.05
    boost_cap: float = 0.95
    gc: float = 0.2
    gc_protected: float = 0.1
    similarity: float = 0.65
    min_diversity: float = 0.0
    q_alpha: float = 0.1
    q_gamma: float = 0.9
    supersession_limit: int = 20
    annotate: bool = False


@dataclass(frozen=True)
class State:
    """The tables that consolidation maps to new ones."""

    edges: DataFrame
    chunks: DataFrame
    facts: DataFrame
    meta: DataFrame


def diversity(chunks: DataFrame, last: int = 64) -> DataFrame:
    """One row: Shannon entropy of the tokens of the latest chunks (id, text, created_at), over the log of how many differ."""
    recent = chunks.orderBy(F.col("created_at").desc(), "id").limit(last)
    counts = recent.select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    share = F.col("n") / F.col("all")
    entropy = counts.crossJoin(F.broadcast(total)).agg(F.sum(-share * F.log(share)).alias("h"), F.max("kinds").alias("kinds"))
    return entropy.select(F.when(F.col("kinds") > 1, F.col("h") / F.log("kinds")).otherwise(F.lit(0.0)).alias("diversity"))


def contradicted(entries: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(id) of edges with a similar decision elsewhere whose outcome contradicts theirs.

    Decisions of equal token sets are grouped; similar sets are found by the set-similarity join, in which sets with a failure meet those with another outcome alone.
    """
    items = entries.select("id", F.array_sort(F.array_distinct(tx.tokens(F.col("decision")))).alias("tokens"), tx.outcome_polarity(F.col("outcome")).alias("p"))
    items = items.filter(F.size("tokens") > 0).withColumn("failed", F.coalesce(~F.col("p"), F.lit(False)))
    sets = items.groupBy("tokens").agg(F.min("id").alias("set"), F.bool_or("failed").alias("bad"), F.bool_or(~F.col("failed")).alias("good"))
    sets = materialise(sets, "decision-sets")
    found = materialise(opposed_pairs(sets.select(F.col("set").alias("id"), "tokens", F.col("bad").alias("left"), F.col("good").alias("right")), threshold).select("a", "b"), "opposed-sets")
    own = sets.filter("bad and good").select("set", F.lit(True).alias("bad"), F.lit(True).alias("good"))
    some = found.select(F.col("a").alias("set"), F.lit(False).alias("bad"), F.lit(True).alias("good")).unionByName(found.select(F.col("b").alias("set"), F.lit(True).alias("bad"), F.lit(False).alias("good"))).unionByName(own)
    other = some.groupBy(F.col("set").alias("a")).agg(F.bool_or("bad").alias("bad"), F.bool_or("good").alias("good"))
    at = items.join(sets.select("tokens", F.col("set").alias("a")), "tokens").join(other, "a")
    return at.filter((F.col("failed") & F.col("good")) | (~F.col("failed") & F.col("bad"))).select("id")


def reactivation(entries: DataFrame, now: int, config: Config = Config()) -> DataFrame:
    """(id, score, protected): confidence, +.5 for a failure, +.3 for user feedback, +.2 if contradicted elsewhere, +.2 if used lately."""
    failed = F.coalesce(~tx.outcome_polarity(F.col("outcome")), F.lit(False))
    rows = entries.join(contradicted(entries, config.similarity).withColumn("_c", F.lit(1)), "id", "left")
    recent = F.coalesce(F.lit(now) - F.col("last_accessed_at") <= config.recent_days * DAY, F.lit(False))
    score = F.col("confidence") + 0.5 * failed.cast("int") + 0.3 * (F.col("discovered_by") == "user_feedback").cast("int") + 0.2 * F.coalesce("_c", F.lit(0)) + 0.2 * recent.cast("int")
    return rows.select("id", score.alias("score"), (F.round(score, 9) >= config.protect_at).alias("protected"))


def merge_redundant(edges: DataFrame, now: int) -> DataFrame:
    """Edges with all but one valid edge of the same ends and relation retired: the surest stays, then the latest, then the largest id."""
    w = Window.partitionBy("from_id", "to_id", "relation", F.col("valid_to").isNull()).orderBy(F.col("confidence").desc(), F.col("event_time").desc(), F.col("id").desc())
    loser = F.col("valid_to").isNull() & (F.col("_n") > 1)
    return edges.withColumn("_n", F.row_number().over(w)).withColumn("valid_to", F.when(loser, F.lit(now)).otherwise(F.col("valid_to"))).drop("_n")


def downscale_edges(edges: DataFrame, scores: DataFrame, now: int, config: Config = Config()) -> DataFrame:
    """(id, confidence, retired) of valid edges: decay from an age of a day on, a boost for what was used lately, then collection.

    The half-life follows the source of discovery, others lose a fixed part a day; protected edges (in
    scores) age half as fast and are collected later. User feedback is never collected.
    """
    rows = edges.filter("valid_to is null").join(scores.select("id", "protected"), "id", "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
    days = (F.lit(now) - F.col("discovered_at")) / DAY
    age = F.when(F.col("protected"), days / config.protected_divisor).otherwise(days)
    factor = F.pow(F.lit(config.decay_per_day), age)
    for source, hours in config.half_life_hours:
        factor = F.when(F.col("discovered_by") == source, F.pow(F.lit(0.5), age * 24 / hours)).otherwise(factor)
    faded = F.when(days >= 1, F.col("confidence") * factor).otherwise(F.col("confidence"))
    used = F.coalesce(F.lit(now) - F.col("last_accessed_at") <= config.recent_days * DAY, F.lit(False))
    new = F.when(used, F.least(F.lit(config.boost_cap), faded + config.boost)).otherwise(faded)
    floor = F.when(F.col("protected"), config.gc_protected).otherwise(config.gc)
    return rows.select("id", new.alias("confidence"), ((F.col("discovered_by") != "user_feedback") & (F.round(new, 9) < floor)).alias("retired"))


def downscale_facts(facts: DataFrame, now: int, config: Config = Config()) -> DataFrame:
    """(id, confidence, retired) of valid facts: a half-life counted from the last update, from an age of a day on."""
    days = (F.lit(now) - F.col("updated_at")) / DAY
    new = F.when(days >= 1, F.col("confidence") * F.pow(F.lit(0.5), days * 24 / config.fact_half_life_hours)).otherwise(F.col("confidence"))
    return facts.filter("valid_to is null").select("id", new.alias("confidence"), ((days >= 1) & (F.round(new, 9) < config.gc)).alias("retired"))


def write_back(rows: DataFrame, downscaled: DataFrame, now: int) -> DataFrame:
    """Edges or facts with their new confidence, and those retired no longer valid."""
    new = downscaled.select("id", F.col("confidence").alias("_c"), "retired")
    joined = rows.join(new, "id", "left")
    return joined.withColumns({"confidence": F.coalesce("_c", "confidence"), "valid_to": F.when(F.col("retired"), F.lit(now)).otherwise(F.col("valid_to"))}).select(*rows.columns)


def reinforce(chunks: DataFrame, edges: DataFrame, meta: DataFrame, protected: DataFrame, config: Config = Config()) -> DataFrame:
    """chunks with a higher q_value at the ends of protected edges (id): one step of graph.q_update each, over valid edges and meta edges."""
    ends = edges.join(protected, "id", "left_semi").select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct().withColumn("_hit", F.lit(True))
    live = lambda df: df.filter("valid_to is null").select("from_id", "to_id")
    q = graph.q_update(chunks.select(F.col("id").alias("node"), F.col("q_value").alias("q")), live(edges).unionByName(live(meta)), config.q_alpha, config.q_gamma)
    new = q.join(ends, "node").select(F.col("node").alias("id"), F.col("q").alias("_q"))
    return chunks.join(new, "id", "left").withColumn("q_value", F.coalesce("_q", "q_value")).select(*chunks.columns)


def superseded(entries: DataFrame, judge: Callable[[DataFrame], DataFrame], config: Config = Config()) -> DataFrame:
    """(old, new): edges that a later record of their decision makes void, as judge says.

    judge gets (old, new, old_decision, old_outcome, new_decision, new_outcome) of the first supersession_limit
    pairs of dml.falsified_pairs and returns them with a column supersedes; the first verdict on an edge counts.
    """
    pairs = dml.falsified_pairs(entries).orderBy("old", "new").limit(config.supersession_limit)
    side = lambda s: entries.select(F.col("id").alias(s), F.col("decision").alias(f"{s}_decision"), F.col("outcome").alias(f"{s}_outcome"))
    asked = materialise(pairs.join(side("old"), "old").join(side("new"), "new").select("old", "new", "old_decision", "old_outcome", "new_decision", "new_outcome"), "supersession-candidates")
    return judge(asked).filter("supersedes").groupBy("old").agg(F.min("new").alias("new"))


def transfers(meta: DataFrame, edges: DataFrame, chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """(from_id, to_id, similarity): decisions at the centre of patterns that are alike across tasks, one of each pair in fresh (id); capped as greedy.accept says."""
    text = chunks.select("id", "text")
    named = meta.filter("valid_to is null").join(text.select(F.col("id").alias("from_id"), F.col("text").alias("_f")), "from_id").join(text.select(F.col("id").alias("to_id"), F.col("text").alias("_t")), "to_id")
    tags = edges.filter("task_tag is not null").select(F.col("from_id").alias("node"), "task_tag").distinct()
    own = named.select("id", F.explode(F.array("from_id", "to_id")).alias("node")).join(tags, "node").groupBy("id").agg(F.collect_set("task_tag").alias("tags"))
    new = fresh.select("id").distinct().withColumn("_new", F.lit(True))
    nodes = materialise(named.join(own, "id").join(new, "id", "left").select("id", "from_id", F.concat_ws(" ", "_f", "_t").alias("text"), "tags", F.coalesce("_new", F.lit(False)).alias("is_new")), "transfer-nodes")
    centre = lambda s: nodes.select(F.col("id").alias(s), F.col("from_id").alias(f"c_{s}"))
    found = patterns.rem_transfer(nodes, meta.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).join(centre("a"), "a").join(centre("b"), "b").filter("c_a <> c_b")
    linked = meta.filter("valid_to is null and relation = 'similar_to'").select(F.col("from_id").alias("c_a"), F.col("to_id").alias("c_b"))
    both = linked.unionByName(linked.select(F.col("c_b").alias("c_a"), F.col("c_a").alias("c_b")))
    open_ = found.join(both, ["c_a", "c_b"], "left_anti").groupBy(F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.max("similarity").alias("similarity"))
    return greedy.accept(open_, patterns.MAX_PAIRS, patterns.MAX_PER_END).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "similarity")


def consolidate(state: State, now: int, config: Config = Config(), judge: Callable[[DataFrame], DataFrame] | None = None, dry_run: bool = False) -> tuple[State, DataFrame]:
    """The new tables, and a report of one row; the old tables stay as they were. With dry_run they are returned unchanged.

    In order: a gate of how diverse the latest texts are; scores of edges, of which the highest are protected;
    Q-values of their ends; supersession, where there is a judge; merging; mining of meta edges from decisions
    and facts; decay, boosts and collection of edges and facts; the mark of what was replayed; transfer between
    tasks. Where texts are too alike nothing is done. In a dry run all meta edges count as new, and mined ones are not written before the transfer.
    """
    spread = diversity(state.chunks).first()
    report = {"diversity": float(spread.diversity if spread and spread.diversity is not None else 0.0)}
    spark = state.edges.sparkSession
    counts = ("protected", "q_updates", "superseded", "merged", "mined", "collected_edges", "collected_facts", "replayed", "transfers")
    if report["diversity"] < config.min_diversity:
        return state, spark.createDataFrame([(report["diversity"], True, *[0] * len(counts))], "diversity double, skipped boolean, " + ", ".join(f"{c} long" for c in counts))
    edges, meta = ensure_schema(state.edges, "causal_edges", extra=True), ensure_schema(state.meta, "meta_causal_edges", extra=True)
    scores = materialise(reactivation(entries_of(edges, state.chunks), now, config), "reactivation")
    protected = scores.filter("protected").select("id")
    report["protected"] = report["q_updates"] = protected.count()
    chunks = materialise(reinforce(state.chunks, edges, meta, protected, config), "consolidated-chunks")

    report["superseded"] = 0
    if judge is not None:
        void = materialise(superseded(entries_of(edges, state.chunks), judge, config), "superseded")
        report["superseded"] = void.count()
        if not dry_run:
            edges = dml.annotate_superseded(edges, void) if config.annotate else dml.invalidate(edges, void.select(F.col("old").alias("id")), now)
    live = lambda df: df.filter("valid_to is null").count()
    before = live(edges)
    merged = materialise(merge_redundant(edges, now), "merged")
    after_merge = live(merged)
    report["merged"] = before - after_merge
    known = merged if not dry_run else edges

    mined = materialise(patterns.mine(entries_of(known, chunks), state.facts), "mined")
    report["mined"] = mined.count()
    batch = mined.withColumns({"id": F.xxhash64("from_id", "to_id", "relation"), "pattern": F.concat_ws(" ", "relation", "from_id", "to_id")}).withColumnRenamed("strata", "strata_count")
    new_meta = materialise(dml.upsert_meta(meta, batch, now), "mined-meta") if not dry_run else meta
    fresh = new_meta if dry_run else new_meta.join(mined, ["from_id", "to_id", "relation"], "left_semi")

    faded = materialise(downscale_edges(known, scores, now, config), "downscaled")
    faded_facts = materialise(downscale_facts(state.facts, now, config), "downscaled-facts")
    report["collected_edges"], report["collected_facts"] = faded.filter("retired").count(), faded_facts.filter("retired").count()
    written = write_back(known, faded, now)
    hit = protected.withColumn("_p", F.lit(True))
    marked = F.col("_p") & F.col("valid_to").isNull()
    written = materialise(written.join(hit, "id", "left").withColumn("last_accessed_at", F.when(marked, F.lit(now).cast("long")).otherwise(F.col("last_accessed_at"))).select(*edges.columns), "consolidated")
    report["replayed"] = 0 if dry_run else written.join(protected, "id", "left_semi").filter("valid_to is null").count()

    moved = materialise(transfers(new_meta, known, chunks, fresh.select("id")), "transfers")
    report["transfers"] = moved.count()
    row = spark.createDataFrame([(report["diversity"], False, *[int(report[c]) for c in counts])], "diversity double, skipped boolean, " + ", ".join(f"{c} long" for c in counts))
    if dry_run:
        return state, row
    linked = moved.select(F.xxhash64("from_id", "to_id", F.lit("similar_to")).alias("id"), "from_id", "to_id", F.lit("similar_to").alias("relation"), F.lit("transfer between tasks").alias("pattern"), F.col("similarity").alias("confidence"))
    new_meta = materialise(dml.upsert_meta(new_meta, linked, now), "consolidated-meta")
    facts = materialise(write_back(state.facts, faded_facts, now), "consolidated-facts")
    return State(written, chunks, facts, new_meta), row
