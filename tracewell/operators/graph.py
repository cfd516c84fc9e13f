"""The typed graph: build, signed spreading activation, learning rules, refutation, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators.blocks import parts_of
from tracewell.operators.components import connected_components
from tracewell.session import materialise, release

#: How much of an activation each relation passes on; unknown relations pass none.
COEFFICIENTS = {"caused": 1.0, "fact": 0.8, "meta": 0.6, "enabled": 0.5, "co_occurrence": 1.0, "prevented": -0.3, "no_effect": 0.0}
DECAY, THRESHOLD, MAX_HOPS, LTP, LTD, GC, WEIGHT_CAP = 0.7, 0.1, 5, 1.05, 0.99, 0.05, 2.0
#: Nodes in a part of what can be reached from a node, about.
LIST = 1024
#: Deals of a part of retrievals, in each of which a pair is counted once.
DEALS = 16
META_RELATIONS = ("similar_to", "repeated", "contradicts", "refines")


def coefficient(relation: Column) -> Column:
    out = F.lit(0.0)
    for name, value in COEFFICIENTS.items():
        out = F.when(relation == name, F.lit(value)).otherwise(out)
    return out


def build(edges: DataFrame, meta: DataFrame | None = None, facts: DataFrame | None = None, cooccurrence: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(src, dst, relation, weight, valid) from all sources of edges that are given; links go both ways."""
    parts = [edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "relation", F.col("confidence").alias("weight"), F.col("valid_to").isNull().alias("valid"))]
    if meta is not None:
        parts.append(meta.filter("valid_to is null").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("meta").alias("relation"), F.col("confidence").alias("weight"), F.lit(True).alias("valid")))
    if facts is not None:
        live = facts.filter("valid_to is null")
        parts.append(live.select(F.concat(F.lit("scope:"), "scope").alias("src"), F.concat(F.lit("fact:"), "id").alias("dst"), F.lit("fact").alias("relation"), F.col("confidence").alias("weight"), F.lit(True).alias("valid")))
    if cooccurrence is not None:
        parts.append(cooccurrence.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("co_occurrence").alias("relation"), "weight", F.lit(True).alias("valid")))
    if links is not None:
        one = links.select(F.concat(F.lit("fact:"), "fact_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("fact").alias("relation"), "weight", F.lit(True).alias("valid"))
        parts += [one, one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight", "valid")]
    return reduce(DataFrame.unionByName, parts)


def spread(graph: DataFrame, seeds: DataFrame, reverse: bool = False, inhibition: bool = True, max_hops: int = MAX_HOPS, by: tuple[str, ...] = ()) -> DataFrame:
    """(node, activation) of at least THRESHOLD in size, from seeds (node, q) that begin at 0.5 + 0.5 q; of each value of by apart.

    In each hop a node gets the sum of what active nodes pass on, held to [-1, 1], and keeps the larger
    of that and what it had. Spreading ends when no node becomes active, or after max_hops. Each hop's
    activations are written to the shared folder; a flag comes to the driver. A value of by whose own
    spreading has ended is left as it is.
    """
    value = F.col("weight") * coefficient(F.col("relation")) * DECAY
    passing = graph.filter("valid").select(F.col("dst" if reverse else "src").alias("_s"), F.col("src" if reverse else "dst").alias("_t"), value.alias("_v")).filter("_v <> 0")
    if not inhibition:
        passing = passing.filter("_v > 0")
    passing = materialise(passing, "spread-edges")
    begun = seeds.select(*by, "node", (0.5 + 0.5 * F.col("q")).alias("activation"), F.lit(True).alias("fresh"))
    now = materialise(begun, "spread")
    for _ in range(max_hops):
        active = now.filter(F.abs("activation") >= THRESHOLD)
        if by:
            active = active.join(now.filter("fresh").select(*by).distinct(), list(by), "left_semi")
        got = active.join(passing, F.col("node") == F.col("_s")).groupBy(*by, F.col("_t").alias("node")).agg(F.sum(F.col("activation") * F.col("_v")).alias("_sum"))
        new = got.select(*by, "node", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "_sum")).alias("_new"))
        had = F.coalesce("activation", F.lit(0.0))
        merged = F.when(F.abs(F.coalesce("_new", F.lit(0.0))) > F.abs(had), F.col("_new")).otherwise(had)
        both = now.drop("fresh").join(new, [*by, "node"], "full_outer").select(*by, "node", merged.alias("activation"), ((F.abs(had) < THRESHOLD) & (F.abs(merged) >= THRESHOLD)).alias("fresh"))
        before, now = now, materialise(both, "spread")
        release(before)
        if now.filter("fresh").isEmpty():
            break
    return now.filter(F.abs("activation") >= THRESHOLD).drop("fresh")


def most_passed(graph: DataFrame) -> DataFrame:
    """One row (most): the largest sum of the sizes of what the valid edges into a node can pass on in a hop."""
    passed = graph.filter("valid").groupBy("dst").agg(F.sum(F.abs(F.col("weight") * coefficient(F.col("relation")) * DECAY)).alias("_p"))
    return passed.agg(F.max("_p").alias("most"))


def entity_links(facts: DataFrame, chunks: DataFrame, min_tokens: int = 3, df_limit: int = 20, most: int = 8) -> DataFrame:
    """(fact_id, chunk_id, shared, weight): chunks that share tokens, none of them common, with a fact; the best of each fact."""
    fact = facts.filter("valid_to is null").select(F.col("id").alias("fact_id"), F.explode(F.array_distinct(tx.tokens(F.concat(F.translate("key", "_", " "), F.lit(" "), "value")))).alias("token"))
    chunk = chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    rare = chunk.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= df_limit).select("token")
    pairs = fact.join(rare, "token").join(chunk, "token").groupBy("fact_id", "chunk_id").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_tokens)
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("fact_id").orderBy(F.col("shared").desc(), "chunk_id"))).filter(F.col("_n") <= most).drop("_n")
    return ranked.withColumn("weight", F.least(F.lit(0.8), 0.3 + 0.1 * F.col("shared")))


def link_audit(facts: DataFrame, chunks: DataFrame, min_tokens: int = 3, df_limit: int = 20, most: int = 8) -> DataFrame:
    """One row: valid facts, those linked, links, most links of a fact, and components, largest and isolated of facts and chunks under these limits.

    Facts and chunks are different nodes even where their ids are equal.
    """
    links = materialise(entity_links(facts, chunks, min_tokens, df_limit, most), "link-audit")
    fact, chunk = (lambda c: F.concat(F.lit("f:"), c.cast("string"))), (lambda c: F.concat(F.lit("c:"), c.cast("string")))
    live = facts.filter("valid_to is null").select("id").distinct()
    nodes = live.select(fact(F.col("id")).alias("node")).unionByName(chunks.select(chunk(F.col("id")).alias("node")).distinct())
    edges = links.select(fact(F.col("fact_id")).alias("from_id"), chunk(F.col("chunk_id")).alias("to_id"), F.lit(None).cast("long").alias("valid_to"))
    counts = links.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("linked"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.max("n"), F.lit(0)).alias("most_links"))
    return live.agg(F.count(F.lit(1)).alias("facts")).crossJoin(counts).crossJoin(component_stats(nodes, edges).drop("valid_edges"))


def hebbian(cooccurrence: DataFrame, decay: float = 0.995, rate: float = 0.02) -> DataFrame:
    """Weights after one step: (1 - decay) w + rate where both ends were active (column active), at most WEIGHT_CAP."""
    return cooccurrence.withColumn("weight", F.least(F.lit(WEIGHT_CAP), (1 - decay) * F.col("weight") + F.when(F.col("active"), F.lit(rate)).otherwise(F.lit(0.0))))


def q_update(nodes: DataFrame, edges: DataFrame, alpha: float = 0.1, gamma: float = 0.9, reward: float = 1.0) -> DataFrame:
    """(node, q) after one batch step: q + alpha (reward + gamma max(0, best next q) - q), held to [0, 1]."""
    following = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("_to")).join(nodes.select(F.col("node").alias("_to"), F.col("q").alias("_q")), "_to").groupBy("node").agg(F.max("_q").alias("_next"))
    new = F.col("q") + alpha * (reward + gamma * F.greatest(F.lit(0.0), F.coalesce("_next", F.lit(0.0))) - F.col("q"))
    return nodes.join(following, "node", "left").select("node", F.greatest(F.lit(0.0), F.least(F.lit(1.0), new)).alias("q"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) over valid edges."""
    live = edges.filter("valid_to is null")
    ends = live.select(F.col("from_id").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(live.select(F.col("to_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def component_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: components, largest, isolated nodes, valid edges."""
    live = edges.filter("valid_to is null")
    found = connected_components(live.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    all_nodes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = all_nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum((F.col("n") == 1).cast("long")).alias("isolated")).crossJoin(live.agg(F.count(F.lit(1)).alias("valid_edges")))


def _neighbours(edges: DataFrame) -> DataFrame:
    live = edges.filter("valid_to is null and from_id <> to_id")
    return live.select(F.col("from_id").alias("n"), F.col("to_id").alias("m")).unionByName(live.select(F.col("to_id").alias("n"), F.col("from_id").alias("m"))).distinct()


def neighbour_overlap(edges: DataFrame) -> DataFrame:
    """(id, shared, jaccard) of each valid edge: neighbours that its ends have in common, the ends left out.

    Only the neighbours of the end with fewer are looked up among those of the other, so a hub's are not listed for
    each of its edges; all sizes follow from the degrees. Edges between the same two nodes are looked at once.
    """
    near = materialise(_neighbours(edges), "overlap-neighbours")
    live = edges.filter("valid_to is null").select("id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    degree = near.groupBy(F.col("n").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    side = lambda s: degree.select(F.col("node").alias(s), F.col("d").alias(f"d_{s}"))
    pairs = materialise(live.select("a", "b").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({"d_a": F.coalesce("d_a", F.lit(0)), "d_b": F.coalesce("d_b", F.lit(0))}), "overlap-pairs")
    fewer = F.col("d_a") <= F.col("d_b")
    asked = pairs.filter("a <> b").select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("n"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("_other"))
    wedges = asked.join(near, "n").select("a", "b", F.col("_other").alias("n"), "m")
    counts = wedges.join(near, ["n", "m"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    loop = F.col("a") == F.col("b")
    shared = F.when(loop, F.col("d_a")).otherwise(F.coalesce("shared", F.lit(0)))
    union = F.when(loop, F.col("d_a")).otherwise(F.col("d_a") + F.col("d_b") - 2 - F.coalesce("shared", F.lit(0)))  # each end is a neighbour of the other
    of = pairs.join(counts, ["a", "b"], "left").select("a", "b", shared.alias("shared"), union.alias("_u"))
    return live.join(of, ["a", "b"]).select("id", "shared", F.coalesce(F.col("shared") / F.nullif("_u", F.lit(0)), F.lit(0.0)).alias("jaccard"))


def _reached(step: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """(node, bits) and (node, part, list): what one or two steps (_a, _b) from a node lead to, in 2^bits parts by a hash of LIST about.

    An element is (mid, via): via is the inner node where there is one way alone and it has one, else null.
    """
    rows = step.select(F.col("_a").alias("node"), F.col("_b").alias("mid"), F.lit(None).cast(step.schema["_a"].dataType).alias("via"))
    if steps == 2:
        rows = rows.unionByName(step.join(step.select(F.col("_a").alias("_b"), F.col("_b").alias("mid")), "_b").select(F.col("_a").alias("node"), "mid", F.col("_b").alias("via")).filter("node <> mid"))
    one = (F.count(F.lit(1)) == F.count("via")) & (F.min("via") == F.max("via"))
    walks = materialise(rows.groupBy("node", "mid").agg(F.when(one, F.min("via")).alias("via")), "refute-walks")
    bits = walks.groupBy("node").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / LIST))).cast("int").alias("bits"))
    parts = walks.join(bits, "node").select("node", F.pmod(F.xxhash64("mid"), F.expr("shiftleft(1L, bits)")).alias("part"), F.struct("mid", "via").alias("e"))
    return bits, parts.groupBy("node", "part").agg(F.collect_list("e").alias("list"))


def _other_paths(live: DataFrame, max_hops: int) -> DataFrame:
    """(from_id, to_id) of edges beside which another simple path of max_hops edges at most leads.

    That is a parallel edge, or a path whose inner nodes are neither end, which no edge between the ends can be on.
    Up to four edges, what two steps from a node and into a node lead to is listed once for each node, and an edge meets the lists of
    its ends, so walks are not told apart by edges. Longer paths go on from there with walks of the edges still open.
    """
    pairs = live.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    step = materialise(pairs.filter("from_id <> to_id").select(F.col("from_id").alias("_a"), F.col("to_id").alias("_b")), "refute-steps")
    ends = ["from_id", "to_id"]
    open_ = pairs.filter("n = 1").select(*ends)
    found = [pairs.filter("n > 1").select(*ends)]
    if max_hops >= 2:
        bits_a, ahead = _reached(step, 2 if max_hops >= 3 else 1)
        bits_b, behind = _reached(step.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")), 2 if max_hops >= 4 else 1)
        own = lambda rows, end, b: rows.select(F.col("node").alias(end), F.col(b))
        asked = open_.join(own(bits_a.withColumnRenamed("bits", "bits_a"), "from_id", "bits_a"), "from_id").join(own(bits_b.withColumnRenamed("bits", "bits_b"), "to_id", "bits_b"), "to_id")
        asked = asked.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, greatest(bits_a, bits_b)) - 1"))))
        asked = asked.select(*ends, F.expr("_p % shiftleft(1L, bits_a)").alias("_pa"), F.expr("_p % shiftleft(1L, bits_b)").alias("_pb"))
        met = asked.join(ahead.select(F.col("node").alias("from_id"), F.col("part").alias("_pa"), F.col("list").alias("_la")), ["from_id", "_pa"])
        over = lambda of, end: F.transform(F.filter(of, lambda e: (e.mid != F.col(end)) & (e.via.isNull() | (e.via != F.col(end)))), lambda e: e.mid)
        met = met.select(*ends, "_pb", over("_la", "to_id").alias("_la")).join(behind.select(F.col("node").alias("to_id"), F.col("part").alias("_pb"), F.col("list").alias("_lb")), ["to_id", "_pb"])
        found.append(materialise(met.filter(F.arrays_overlap("_la", over("_lb", "from_id"))).select(*ends).distinct(), "refute-hits"))
    if max_hops > 4:
        open_ = open_.join(found[1], ends, "left_anti")
        ahead, behind = open_.withColumn("at", F.col("from_id")), open_.withColumn("at", F.col("to_id"))
        for length in range(2, max_hops + 1):
            if length == 2 or length % 2:
                ahead = materialise(ahead.join(step, F.col("at") == F.col("_a")).filter("_b <> from_id and _b <> to_id").select(*ends, F.col("_b").alias("at")).distinct(), "refute-ahead")
            if length % 2 == 0:
                behind = materialise(behind.join(step, F.col("at") == F.col("_b")).filter("_a <> from_id and _a <> to_id").select(*ends, F.col("_a").alias("at")).distinct(), "refute-behind")
            if length > 4:
                hit = materialise(ahead.join(behind, [*ends, "at"], "left_semi").select(*ends).distinct(), "refute-hits")
                found.append(hit)
                ahead, behind = ahead.join(hit, ends, "left_anti"), behind.join(hit, ends, "left_anti")
    return reduce(DataFrame.unionByName, found)


def refute(edges: DataFrame, max_hops: int = 4, sample: int = 20, placebos: int = 5) -> DataFrame:
    """(id, confounder, corroboration, placebo, grade) of each valid edge; tests are 1 (robust), 0 or -1 (refuted).

    confounder: Jaccard overlap of the ends' neighbours, 0.15 or more robust, under 0.03 refuted.
    corroboration: another simple path of max_hops edges at most is robust; else two edges into the end leave it open.
    placebo: of up to placebos sampled nodes of a similar out-degree, the share that reaches the end in 3 hops;
    1 / (share + 0.1) of 2 or more is robust, under 1 refuted, fewer than 3 nodes open. The sample of nodes is
    fixed by a hash of their ids. Grades: A all robust; B two, none refuted; C none refuted; F two refuted; D else.
    """
    live = materialise(edges.filter("valid_to is null").select("id", "from_id", "to_id"), "refute-edges")
    step = live.select(F.col("id").alias("_e"), F.col("from_id").alias("_a"), F.col("to_id").alias("_b"))
    paths = live.join(_other_paths(live, max_hops), ["from_id", "to_id"]).select("id", F.lit(True).alias("path"))
    degree = degrees(edges)
    chosen = degree.filter("out_degree > 0").orderBy(F.md5(F.col("node").cast("string")), "node").limit(sample + 1).select(F.col("node").alias("c"), F.col("out_degree").alias("dc"), F.md5(F.col("node").cast("string")).alias("h"))
    chosen = materialise(chosen, "refute-sample")
    at, near = chosen.select("c", F.col("c").alias("at")), []
    for _ in range(3):
        at = at.join(step, F.col("at") == F.col("_a")).select("c", F.col("_b").alias("at")).distinct()
        near.append(at)
    near = reduce(DataFrame.unionByName, near).distinct().withColumn("hit", F.lit(1))
    out_of = degree.select(F.col("node").alias("from_id"), F.col("out_degree").alias("df"))
    tried = live.join(out_of, "from_id").crossJoin(F.broadcast(chosen)).filter("c <> from_id and c <> to_id and abs(dc - df) <= df * 0.5 + 1")
    tried = tried.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("h", "c"))).filter(F.col("n") <= placebos)
    hits = tried.join(near.select("c", F.col("at").alias("to_id"), "hit"), ["c", "to_id"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k"))
    into = degree.select(F.col("node").alias("to_id"), "in_degree")
    rows = live.join(neighbour_overlap(edges), "id").join(paths, "id", "left").join(hits, "id", "left").join(into, "to_id")
    share = F.col("k") / F.nullif("n", F.lit(0)) + 0.1
    tests = rows.select(
        "id", F.when(F.col("jaccard") >= 0.15, 1).when(F.col("jaccard") < 0.03, -1).otherwise(0).alias("confounder"),
        F.when(F.col("path"), 1).when(F.col("in_degree") >= 2, 0).otherwise(-1).alias("corroboration"),
        F.when(F.coalesce("n", F.lit(0)) < 3, 0).when(F.round(share, 9) <= 0.5, 1).when(F.round(share, 9) > 1, -1).otherwise(0).alias("placebo"),
    )
    count = lambda v: sum((F.when(F.col(t) == v, 1).otherwise(0) for t in ("confounder", "corroboration", "placebo")), F.lit(0))
    good, bad = count(1), count(-1)
    return tests.withColumn("grade", F.when(good >= 3, "A").when((good >= 2) & (bad == 0), "B").when(bad == 0, "C").when(bad >= 2, "F").otherwise("D"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 10) -> DataFrame:
    """(node, p) after so many steps of p = alpha S'p + (1 - alpha) s, S row-normalised by confidence, s uniform over the seeds (node)."""
    live = edges.filter("valid_to is null").select(F.col("from_id").alias("_a"), F.col("to_id").alias("_b"), F.col("confidence").alias("_c"))
    total = live.groupBy("_a").agg(F.sum("_c").alias("_all"))  # summed before it is shuffled, so a hub is one row a task
    step = materialise(live.join(total, "_a").select("_a", "_b", "_c", (F.col("_c") / F.nullif("_all", F.lit(0.0))).alias("_w")), "ppr-edges")
    start = materialise(seeds.select("node").distinct().crossJoin(seeds.select("node").distinct().agg((1.0 / F.count(F.lit(1))).alias("s"))), "ppr-seeds")
    p = start.select("node", F.col("s").alias("p"))
    for _ in range(iterations):
        moved = p.join(step, F.col("node") == F.col("_a")).select(F.col("_b").alias("node"), (alpha * F.col("p") * F.col("_w")).alias("p"))
        before, p = p, materialise(moved.unionByName(start.select("node", ((1 - alpha) * F.col("s")).alias("p"))).groupBy("node").agg(F.sum("p").alias("p")), "ppr")
        release(before)
    return p


def cooccurrence(retrievals: DataFrame) -> DataFrame:
    """(from_id, to_id, n, weight) of ordered pairs retrieved together: retrievals (retrieval, id, place), of an id that a retrieval has several times the first place.

    Rows are counted, and dealt once by retrieval into parts that do not grow with them. Pairs are listed and counted within a part
    first, in deals of it, so a pair that many retrievals have is shuffled a few times alone.
    """
    parts = parts_of(retrievals, 2 * retrievals.count())  # a row gives more pairs than one
    dealt = retrievals.withColumn("_deal", F.pmod(F.xxhash64("retrieval"), F.lit(DEALS * parts))).repartition(parts, "_deal")
    firsts = dealt.groupBy("_deal", "retrieval", "id").agg(F.min("place").alias("place"))
    held = firsts.filter("retrieval is not null").groupBy("_deal", "retrieval").agg(F.collect_list(F.struct("place", "id")).alias("m"))  # what was retrieved at once
    later = F.filter("m", lambda y: (y.place > F.col("a.place")) & (y.id != F.col("a.id")))
    pairs = held.select("_deal", "m", F.explode("m").alias("a")).select("_deal", F.col("a.id").alias("from_id"), F.explode(later).alias("b"))
    counted = pairs.groupBy("_deal", "from_id", F.col("b.id").alias("to_id")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.repartition(parts, "from_id", "to_id").groupBy("from_id", "to_id").agg(F.sum("n").alias("n"))
    return counted.withColumn("weight", F.least(F.lit(1.0), 0.2 + 0.05 * (F.col("n") - 1)))
