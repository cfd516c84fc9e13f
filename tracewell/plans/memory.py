"""The facade: a store's tables and the questions asked of them, many at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import bm25, consolidate, dml, fusion, graph, hops, novelty, patterns, predict, trace, vector
from tracewell.operators.blocks import containing
from tracewell.plans import router
from tracewell.schema import entries
from tracewell.session import materialise

#: Seeds of a question from each source, what ranks add to in a score, the similarity of decisions alike, and under what agreement a lesson is unreliable.
SEEDS, RANK_OFFSET, ALIKE, LOW_AGREEMENT = 16, 60, 0.5, 0.5
#: Scopes that a question may be kept to; others name a tenant.
SCOPES = ("user", "session", "agent")


def first_that_has(*lists: DataFrame) -> DataFrame:
    """For each question the rows of the first list that has any; lists have the same columns."""
    held = [materialise(x, "cascade") for x in lists[:-1]] + [lists[-1]]
    out = held[0]
    for x in held[1:]:
        out = out.unionByName(x.join(out.select("qid").distinct(), "qid", "left_anti"))
    return out


def valid_scope(scope: Column) -> Column:
    """Whether a scope is one of SCOPES, or names a tenant: two parts that are not empty, with a colon between them."""
    return scope.isin(*SCOPES) | F.regexp_like(scope, F.lit("^[^:]+:[^:]+$"))


def session_key(node: Column) -> Column:
    """The first two parts of a node's id of three or more, else null."""
    parts = F.split(node, "::")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 2), "::"))


@dataclass(frozen=True)
class Memory:
    """Tables of one store; a user's own store is a filter on a user column before it gets here.

    Vectors (id, vector) of edges and facts are those of a model of the caller's; questions (qid, query) that
    are to be met by them have a column query_vector. Without either, what asks for similarity gives nothing.
    """

    chunks: DataFrame
    edges: DataFrame
    meta: DataFrame
    facts: DataFrame
    edge_vectors: DataFrame | None = None
    fact_vectors: DataFrame | None = None

    @property
    def entries(self) -> DataFrame:
        return entries(self.edges, self.chunks)

    @property
    def live_facts(self) -> DataFrame:
        return self.facts.filter("valid_to is null")

    def kept_to(self, task_tag: str | None = None, scope: str | None = None) -> Memory:
        """The store as a question with this tag and scope sees it."""
        edges = self.edges if task_tag is None else self.edges.filter(F.col("task_tag") == task_tag)
        return replace(self, edges=edges, facts=self.facts if scope is None else self.facts.filter(F.col("scope") == scope))

    def _texts(self) -> DataFrame:
        return self.entries.select("id", F.concat_ws(" ", "decision", "outcome").alias("text"))

    # ---- Layers

    def _none(self, queries: DataFrame) -> DataFrame:
        return queries.limit(0).select("qid", F.lit("").alias("id"), F.lit(0).cast("long").alias("rank"))

    def _ranked(self, rows: DataFrame) -> DataFrame:
        return rows.select("qid", F.col("id").cast("string").alias("id"), "rank")

    def causal_bm25(self, queries: DataFrame, limit: int) -> DataFrame:
        return self._ranked(bm25.bm25(self._texts(), queries, limit))

    def causal_semantic(self, queries: DataFrame, limit: int) -> DataFrame:
        """Edges by similarity of their vectors, which shared entities raise."""
        if self.edge_vectors is None or "query_vector" not in queries.columns:
            return self._none(queries)
        items = self.entries.select("id", tx.entity_tokens(F.concat_ws(" ", "decision", "outcome")).alias("entities")).join(self.edge_vectors, "id")
        asked = queries.filter("query_vector is not null").select("qid", "query_vector", tx.entity_tokens(F.col("query")).alias("query_entities"))
        return self._ranked(vector.entity_boosted(items, asked, limit))

    def causal_listing(self, queries: DataFrame, limit: int) -> DataFrame:
        """The surest edges, for questions without a word."""
        blank = queries.filter(F.trim(F.coalesce("query", F.lit(""))) == "").select("qid")
        sure = self.entries.orderBy(F.col("confidence").desc(), "id").limit(limit).select("id", "confidence")
        return self._ranked(bm25.top(blank.crossJoin(F.broadcast(sure)), limit, F.col("confidence").desc(), "id"))

    def facts_bm25(self, queries: DataFrame, limit: int) -> DataFrame:
        return self._ranked(bm25.search_facts(self.facts, queries, limit))

    def facts_semantic(self, queries: DataFrame, limit: int) -> DataFrame:
        """Valid facts by similarity of their vectors."""
        if self.fact_vectors is None or "query_vector" not in queries.columns:
            return self._none(queries)
        items = self.fact_vectors.join(self.live_facts.select("id"), "id", "left_semi")
        return self._ranked(vector.semantic(items, queries.filter("query_vector is not null").select("qid", "query_vector"), limit))

    def facts_listing(self, queries: DataFrame, limit: int) -> DataFrame:
        """The facts renewed last."""
        latest = self.live_facts.orderBy(F.col("updated_at").desc(), "id").limit(limit).select("id", "updated_at")
        return self._ranked(bm25.top(queries.select("qid").crossJoin(F.broadcast(latest)), limit, F.col("updated_at").desc(), "id"))

    # ---- Searches

    def seeds(self, queries: DataFrame, limit: int = SEEDS) -> DataFrame:
        """(qid, id, overlap, rank): chunks and valid facts ("fact:n") by the distinct tokens that they share with a question."""
        known = self.live_facts.select(F.concat(F.lit("fact:"), "id").alias("id"), F.concat(F.translate("key", "_", " "), F.lit(" "), "value").alias("text"))
        return bm25.token_overlap(self.chunks.select("id", "text").unionByName(known), queries, limit)

    def unified(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(qid, id, rank) by one spreading a question over all kinds of nodes: facts ("fact:n") by activation, then edges ("causal:n") by that of their ends.

        It begins at what shares words with the question, or is similar to it: SEEDS of each kind at most.
        """
        decision = self.edges.select(F.col("id").cast("string").alias("id"), F.col("from_id").alias("node"))
        begin = self.seeds(queries).select("qid", F.col("id").alias("node")).unionByName(self.facts_semantic(queries, SEEDS).select("qid", F.concat(F.lit("fact:"), "id").alias("node")))
        begin = begin.unionByName(self.causal_semantic(queries, SEEDS).join(decision, "id").select("qid", "node")).distinct()
        q = self.chunks.select(F.col("id").alias("node"), F.col("q_value").alias("q")).unionByName(self.live_facts.select(F.concat(F.lit("fact:"), "id").alias("node"), F.lit(0.5).alias("q")))
        links = graph.entity_links(self.facts, self.chunks).select("fact_id", "chunk_id", "weight")
        active = materialise(graph.spread(graph.build(self.edges, self.meta, self.facts, links=links), begin.join(q, "node"), by=("qid",)), "unified")
        known = active.filter(F.col("node").startswith("fact:")).withColumn("id", F.expr("try_cast(substr(node, 6) as bigint)")).join(self.live_facts.select("id"), "id", "left_semi")
        facts = bm25.top(known.select("qid", F.col("node").alias("id"), F.abs("activation").alias("size")), limit, F.round("size", 9).desc(), "id").select("qid", "id", "rank")
        turns = active.filter(~F.col("node").startswith("fact:") & ~F.col("node").startswith("scope:"))
        edges = hops.touching_by_activation(self.entries, turns, limit)
        n = facts.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        behind = edges.join(n, "qid", "left").select("qid", F.concat(F.lit("causal:"), "id").alias("id"), (F.col("rank") + F.coalesce("n", F.lit(0))).alias("rank"))
        return facts.unionByName(behind)

    def dual_pool(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(qid, id, rank): both layers, each by similarity or else by BM25, and the neighbours of the edges found, fused by rank."""
        wide = max(2 * limit, 10)
        causal = materialise(first_that_has(self.causal_semantic(queries, wide), self.causal_bm25(queries, wide)), "dual-pool")
        known = first_that_has(self.facts_semantic(queries, wide), self.facts_bm25(queries, wide))
        near = hops.hop_expansion(self.entries, causal.select("qid", F.col("id").cast("long").alias("id")), queries, wide).select("qid", "id", "rank")
        named = lambda rows, kind: rows.select("qid", F.concat(F.lit(kind), "id").alias("id"), "rank")
        return fusion.rrf([named(known, "fact:"), named(causal, "causal:"), named(near, "causal:")], limit).select("qid", "id", "rank")

    def search_memory(self, queries: DataFrame, limit: int = 10, task_tag: str | None = None, scope: str | None = None) -> DataFrame:
        """(qid, id, rank, score, intent, shown): the answer of unified, or else of dual_pool, to each question.

        shown is false for the layer that a question plainly does not ask for, where the other has hits.
        """
        own = self.kept_to(task_tag, scope)
        found = materialise(first_that_has(own.unified(queries, limit), own.dual_pool(queries, limit)), "search-memory")
        is_fact = F.col("id").startswith("fact:")
        has = found.groupBy("qid").agg(F.bool_or(is_fact).alias("_facts"), F.bool_or(~is_fact).alias("_causal"))
        rows = found.join(has, "qid").join(queries.select("qid", router.classify(F.col("query")).alias("intent")), "qid")
        hidden = (F.col("intent").isin("causal", "chain") & F.col("_causal") & is_fact) | ((F.col("intent") == "fact") & F.col("_facts") & ~is_fact)
        return rows.select("qid", "id", "rank", (1 / (RANK_OFFSET + F.col("rank"))).alias("score"), "intent", (~hidden).alias("shown"))

    def search_causal(self, queries: DataFrame, limit: int = 5, task_tag: str | None = None) -> DataFrame:
        """(qid, id, rank) of edges: those that spreading reaches, or else by similarity, by BM25, and a listing for questions without a word."""
        own = self.kept_to(task_tag)
        edges = own.unified(queries, limit).filter(F.col("id").startswith("causal:"))
        reached = bm25.top(edges.select("qid", F.substring("id", 8, 40).alias("id"), F.col("rank").alias("r")), limit, "r").drop("r")
        return first_that_has(reached, own.causal_semantic(queries, limit), own.causal_bm25(queries, limit), own.causal_listing(queries, limit))

    def search_facts(self, queries: DataFrame, limit: int = 10, scope: str | None = None) -> DataFrame:
        """(qid, id, rank) of facts: by similarity, or else by BM25, or else the latest."""
        own = self.kept_to(scope=scope)
        return first_that_has(own.facts_semantic(queries, limit), own.facts_bm25(queries, limit), own.facts_listing(queries, limit))

    def query_terms(self, terms: DataFrame, limit: int) -> DataFrame:
        """(qid, id, rank): what BM25 finds for each term (qid, place, term), one after the other, each edge at its first place."""
        asked = terms.select(F.struct("qid", "place").alias("qid"), F.col("term").alias("query"))
        hits = bm25.bm25(self._texts(), asked, limit).select("qid.qid", "id", F.struct(F.col("qid.place").alias("place"), F.col("rank").alias("rank")).alias("at"))
        first = hits.groupBy("qid", "id").agg(F.min("at").alias("at"))
        return first.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).cast("long").alias("rank"))

    def search_multi_pass(self, queries: DataFrame, now: int, limit: int = 10) -> DataFrame:
        """(qid, id, rank): the whole question, then each thing it names; within a time it means, then the latest first.

        The second pass is for questions that ask for all evidence or mean a time, or whose hits lie in two sessions or more.
        """
        plans = materialise(router.plan(queries.select("qid", "query"), F.lit(now).cast("long")), "question-plans")
        base = materialise(self.causal_bm25(queries, limit), "multi-pass")
        at = self.edges.select(F.col("id").cast("string").alias("id"), session_key(F.col("from_id")).alias("session"), "event_time")
        span = base.join(at, "id").groupBy("qid").agg(F.count_distinct("session").alias("span"))
        wide = plans.join(span, "qid", "left").filter(F.col("aggregation") | F.col("window").isNotNull() | (F.coalesce("span", F.lit(0)) >= 2))
        terms = wide.select("qid", F.posexplode("entities").alias("place", "term"))
        more = self.query_terms(terms, limit // 2).withColumn("rank", F.col("rank") + limit)
        merged = base.unionByName(more).groupBy("qid", "id").agg(F.min("rank").alias("at")).join(at, "id").join(plans.select("qid", "window"), "qid")
        timed = F.col("window").isNotNull()
        order = Window.partitionBy("qid").orderBy(F.when(timed, F.col("event_time").between(F.col("window.start"), F.col("window.end"))).desc(), F.when(timed, F.col("event_time")).desc(), "at")
        return merged.select("qid", "id", F.row_number().over(order).cast("long").alias("rank"))

    def search_patterns(self, queries: DataFrame) -> DataFrame:
        """(qid, id, pattern, confidence, note): valid meta edges whose pattern or one of whose two texts contains the question, with a note where the evidence is of one task alone or turns between tasks."""
        text = self.chunks.select("id", "text")
        rows = self.meta.filter("valid_to is null").join(text.select(F.col("id").alias("from_id"), F.col("text").alias("_f")), "from_id", "left").join(text.select(F.col("id").alias("to_id"), F.col("text").alias("_t")), "to_id", "left")
        flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
        note = F.when(flag("simpson"), "the direction turns between tasks").when(flag("confounded"), "seen in one task only")
        said = rows.select("id", "pattern", "confidence", note.alias("note"), F.concat_ws("\n", "pattern", "_f", "_t").alias("_said"))
        return containing(said, "_said", queries.select("qid", "query"), "query").select("qid", "id", "pattern", "confidence", "note")

    # ---- Traces and predictions

    def _containing(self, queries: DataFrame, column: str) -> DataFrame:
        return containing(self.entries.select("id", "confidence", column), column, queries.select("qid", "query").filter("query <> ''"), "query")

    def _anchors(self, queries: DataFrame, seeds: int, column: str) -> DataFrame:
        """Edges whose text contains the question, or else those that BM25 finds."""
        rows = self._containing(queries, column).select("qid", "id")
        found = bm25.bm25(self.entries.select("id", F.col(column).alias("text")), queries, seeds).select("qid", F.col("id").cast("long").alias("id"))
        return first_that_has(rows, found)

    def trace_cause(self, queries: DataFrame) -> DataFrame:
        """(qid, id, confidence, rank): valid edges whose outcome contains the question, the surest first."""
        found = self._containing(queries, "outcome").select("qid", "id", "confidence")
        return bm25.top(found, 2**31 - 1, F.col("confidence").desc(), "id")

    def trace_cause_chains(self, queries: DataFrame, max_depth: int = 3, min_confidence: float = 0.5) -> DataFrame:
        return trace.cause_chains(self.edges, self._anchors(queries, 5, "outcome"), max_depth, min_confidence)

    def trace_effect(self, queries: DataFrame, max_depth: int = 3, min_confidence: float = 0.5) -> DataFrame:
        return trace.effect_chains(self.edges, self._anchors(queries, 5, "decision"), max_depth, min_confidence)

    def _like(self, queries: DataFrame, limit: int) -> DataFrame:
        """(qid, id): edges of decisions like an action: by similarity of ALIKE and more, or else by BM25, or else containing its words."""
        near = self._none(queries).select("qid", "id")
        if self.edge_vectors is not None and "query_vector" in queries.columns:
            items = self.edge_vectors.join(self.entries.select("id"), "id", "left_semi")
            near = vector.semantic(items, queries.filter("query_vector is not null").select("qid", "query_vector"), limit, ALIKE).select("qid", F.col("id").cast("string").alias("id"))
        said = self._containing(queries, "decision").select("qid", F.col("id").cast("string").alias("id"))
        return first_that_has(near, self.causal_bm25(queries, limit).select("qid", "id"), said).select("qid", F.col("id").cast("long").alias("id"))

    def intervene(self, queries: DataFrame, max_depth: int = 3, limit: int = 5) -> DataFrame:
        """What an action would lead to: forward chains with SAFE, DANGER, WARNING or UNKNOWN."""
        found = trace.best(trace.chains(self.edges, self._like(queries, limit), False, max_depth, 0.3))
        return predict.chain_labels(found, self.entries.select("id", "outcome"))

    def intervene_strata(self, queries: DataFrame, limit: int = 5, tags: DataFrame | None = None) -> DataFrame:
        """For each action the outcomes of decisions like it: pooled, within a task (tags: qid, reference; by default that with most of the evidence) and in the others."""
        found = self._like(queries, limit).join(self.entries.select("id", "outcome", "outcome_polarity", "task_tag"), "id")
        evidence = found.select("qid", "id", "task_tag", tx.polarity_bucket(F.col("outcome_polarity"), F.col("outcome")).alias("bucket"))
        return predict.stratified(evidence, "qid", predict.modal_tag(evidence, "qid", "id") if tags is None else tags)

    def compare(self, a: str, b: str, limit: int = 5) -> DataFrame:
        """Which of two actions the evidence favours."""
        asked = self.chunks.sparkSession.createDataFrame([(0, a), (1, b)], "qid long, query string")
        hits = self._like(asked, limit).join(self.entries.select("id", "outcome", "outcome_polarity"), "id")
        bucket = tx.polarity_bucket(F.col("outcome_polarity"), F.col("outcome"))
        return predict.contrast(hits.select(F.lit(0).alias("k"), F.when(F.col("qid") == 0, "a").otherwise("b").alias("side"), bucket.alias("bucket")), "k")

    def lesson(self, query: str, limit: int = 20, query_vector: list[float] | None = None) -> DataFrame:
        """The neighbourhood of the best hits, as stubs of 120 characters at most to be told: by similarity of ALIKE and more, or else by BM25."""
        asked = self.chunks.sparkSession.createDataFrame([(0, query, query_vector)], "qid long, query string, query_vector array<float>")
        near = self._none(asked).select("qid", "id")
        if self.edge_vectors is not None and query_vector is not None:
            items = self.edge_vectors.join(self.entries.select("id"), "id", "left_semi")
            near = vector.semantic(items, asked.select("qid", "query_vector"), 3, ALIKE).select("qid", F.col("id").cast("string").alias("id"))
        seeds = first_that_has(near, self.causal_bm25(asked, 3).select("qid", "id")).select(F.col("id").cast("long").alias("id"))
        around = hops.markov_blanket(self.edges, seeds, limit)
        stub = tx.truncate(F.concat("decision", F.lit(" → "), "relation", F.lit(" → "), "outcome"), 120)
        return around.join(self.entries.select("id", stub.alias("stub")), "id").orderBy("rank")

    def told_lesson(self, query: str, tell: Callable[[DataFrame], DataFrame], samples: int = 0, limit: int = 20, query_vector: list[float] | None = None) -> DataFrame:
        """One row (query, edges, lesson, samples, agreement, unreliable): the lesson as tell reconstructs it from the stubs, and how far further reconstructions agree.

        tell gets (sample, query, stubs, temperature), sample 0 at temperature 0 for the lesson and samples of them at 0.7, two at least or none, and returns (sample, text), null
        or no row where it fails. agreement is null for fewer than two texts; under LOW_AGREEMENT what lies beneath may be unreliable. Without any edge nothing is asked.
        """
        spark = self.chunks.sparkSession
        around = materialise(self.lesson(query, limit, query_vector), "lesson")  # limit rows at most
        stubs = around.agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stub"))), lambda x: x.stub), "\n").alias("stubs"))
        numbers = [(0, 0.0)] + [(k, 0.7) for k in range(1, samples + 1) if samples >= 2]
        asked = stubs.filter("edges > 0").crossJoin(spark.createDataFrame(numbers, "sample long, temperature double"))
        texts = materialise(tell(asked.select("sample", F.lit(query).alias("query"), "stubs", "temperature")).filter("text is not null").select("sample", "text"), "lesson-texts")
        others = texts.filter("sample > 0")
        agreed = novelty.agreement(others.select(F.lit(0).alias("qid"), F.col("sample").alias("id"), "text")).select("agreement")
        row = stubs.select(F.lit(query).alias("query"), "edges").crossJoin(texts.agg(F.max(F.when(F.col("sample") == 0, F.col("text"))).alias("lesson"), F.count_if(F.col("sample") > 0).alias("samples")))
        row = row.join(F.broadcast(agreed), F.col("samples") >= 2, "left")
        return row.withColumn("unreliable", F.coalesce(F.col("agreement") < LOW_AGREEMENT, F.lit(False)))

    # ---- Changes

    def record(self, batch: DataFrame, now: int) -> Memory:
        chunks, edges = dml.record_decisions(self.chunks, self.edges, batch, now)
        return replace(self, chunks=chunks, edges=edges)

    def sleep(self, now: int, config: consolidate.Config = consolidate.Config(), judge: Callable[[DataFrame], DataFrame] | None = None, dry_run: bool = False) -> tuple[Memory, DataFrame]:
        """Consolidation: the new store, and the report."""
        state, report = consolidate.consolidate(consolidate.State(self.edges, self.chunks, self.facts, self.meta), now, config, judge, dry_run)
        return replace(self, edges=state.edges, chunks=state.chunks, facts=state.facts, meta=state.meta), report

    def mine(self) -> DataFrame:
        return patterns.mine(self.entries, self.facts)
