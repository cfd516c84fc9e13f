"""Graph patches against rebuilt graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import graph, inverted, overlay

EDGES = "src string, dst string, relation string, weight double, valid boolean"


def acts(df):
    return {r.node: round(r.activation, 6) for r in df.collect()}


@pytest.mark.parametrize("bound", [100_000, 3])
def test_patched_equals_rebuilt_after_each_batch(spark, tmp_path, monkeypatch, bound):
    """With a small bound every other batch is folded; nothing else differs."""
    monkeypatch.setattr(overlay, "PATCHES", bound)
    rng = random.Random(4)
    relations = ["caused", "caused", "enabled", "prevented", "fact"]
    draw = lambda n: [(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}", rng.choice(relations), rng.randrange(1, 11) / 10) for _ in range(n)]
    base = [(*e, rng.random() < 0.9) for e in draw(25)]
    now = overlay.GraphOverlay.create(spark, f"file://{tmp_path}/g", spark.createDataFrame(base, EDGES))
    state, patched = list(base), {}
    seeds = spark.createDataFrame([("n0", 0.5), ("n1", 1.0)], "node string, q double")
    for step in range(5):
        if step % 3 == 2:
            gone = {(e[0], e[1]) for e in rng.sample(state, 3)} | set(list(patched)[:2])
            now = now.invalidate(spark.createDataFrame(sorted(gone), "src string, dst string"))
            state = [(*e[:4], e[4] and (e[0], e[1]) not in gone) for e in state]
            patched = {k: e for k, e in patched.items() if k not in gone}
        else:
            new = {}
            for e in draw(4):
                new[e[:2]] = max(new.get(e[:2], e), e, key=lambda x: (x[3], x[2]))
            now = now.append_edges(spark.createDataFrame(list(new.values()), EDGES.rsplit(",", 1)[0]))
            patched |= new
        if now.store.properties["patches"] == 0:
            state, patched = state + [(*e, True) for e in patched.values()], {}
        rebuilt = spark.createDataFrame(state + [(*e, True) for e in patched.values()], EDGES)
        key = lambda df: sorted(map(tuple, df.filter("valid").select("src", "dst", "relation", "weight").collect()))
        assert key(now.edges()) == key(rebuilt)
        for reverse in (False, True) if step == 2 else (False,):
            assert acts(now.spread(seeds, reverse=reverse)) == acts(graph.spread(rebuilt, seeds, reverse=reverse))
    assert (now.store.properties["patches"] < 25) and acts(now.fold().spread(seeds)) == acts(now.spread(seeds))


def test_retired_nodes_pass_on_but_are_not_shown(spark, tmp_path):
    base = spark.createDataFrame([("a", "fact:1", "caused", 1.0, True), ("fact:1", "b", "caused", 1.0, True)], EDGES)
    seeds = spark.createDataFrame([("a", 1.0)], "node string, q double")
    retired = lambda name: overlay.GraphOverlay.create(spark, f"file://{tmp_path}/{name}", base).retire(spark.createDataFrame([("fact:1",)], "node string"))
    now = retired("g")
    assert set(acts(now.spread(seeds))) == {"a", "b"}
    assert set(acts(retired("h").fold().spread(seeds))) == {"a"}  # a rebuild has it no more
    assert acts(now.spread(spark.createDataFrame([("fact:1", 1.0)], "node string, q double"))) == {}
    back = now.append_edges(spark.createDataFrame([("b", "fact:1", "caused", 0.5)], "src string, dst string, relation string, weight double"))
    assert set(acts(back.spread(seeds))) == {"a", "b", "fact:1"}
    older = overlay.GraphOverlay.open(spark, f"file://{tmp_path}/g", version=1)
    assert set(acts(older.spread(seeds))) == {"a", "b", "fact:1"}


def test_linked_facts_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["common"] * 20
    chunks = spark.createDataFrame([(f"c{i}", " ".join(rng.choice(words) for _ in range(12))) for i in range(80)], "id string, text string")
    facts = spark.createDataFrame([(i, "likes_these", " ".join(rng.sample(words, 14)), "user", 0.7, None) for i in range(6)], "id long, key string, value string, scope string, confidence double, valid_to long")
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "caused", 0.9, None) for i in range(60)], "from_id string, to_id string, relation string, confidence double, valid_to long")
    index = inverted.InvertedIndex.open(spark, f"file://{tmp_path}/i").append(chunks, buckets=4)
    patched = overlay.GraphOverlay.create(spark, f"file://{tmp_path}/g", graph.build(edges), index).link_facts(facts)
    rebuilt = graph.build(edges, facts=facts, links=graph.entity_links(facts, chunks))
    key = lambda df: sorted((r.src, r.dst, r.relation, round(r.weight, 9)) for r in df.filter("valid").collect())
    assert key(patched.edges()) == key(rebuilt) and len(key(rebuilt)) > 75
    seeds = spark.createDataFrame([("scope:user", 1.0)], "node string, q double")
    assert acts(patched.spread(seeds)) == acts(graph.spread(rebuilt, seeds))
    assert patched.edges().filter(F.col("src").startswith("fact:")).count() > 5
