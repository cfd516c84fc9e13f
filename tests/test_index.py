"""The versioned store, and the inverted index in it."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import bm25, inverted
from tracewell.sources.commits import Conflict, Store


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_are_pinned_and_conflicts_refused(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = spark.createDataFrame([(1, "a")], "id long, x string"), spark.createDataFrame([(2, "b")], "id long, x string")
    first = Store.open(spark, root).publish(replace={"t": one}, properties={"n": 1})
    reader = Store.open(spark, root)
    second = first.publish(append={"t": two}, replace={"u": two}, partition_by={"u": ["id"]})
    assert rows_of(reader.table("t")) == [(1, "a")] and "u" not in reader.folders
    assert rows_of(Store.open(spark, root).table("t")) == [(1, "a"), (2, "b")] and second.version == 2
    assert rows_of(second.table("u").select("id", "x")) == [(2, "b")]
    with pytest.raises(Conflict):
        reader.publish(append={"t": two})
    assert rows_of(Store.open(spark, root).table("t")) == [(1, "a"), (2, "b")]  # the loser's rows are not seen
    third = Store.open(spark, root).publish(replace={"t": one})
    assert rows_of(Store.open(spark, root, 2).table("t")) == [(1, "a"), (2, "b")]
    assert third.expire(1) == 2 and rows_of(Store.open(spark, root).table("t")) == [(1, "a")]  # both folders of t that the last version lacks
    with pytest.raises(ValueError):
        Store.open(spark, root, 2)


def texts(spark, n=400):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["common"] * 150 + ["often"] * 60
    return spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(n)], "id long, text string")


@pytest.fixture()
def questions(spark):
    rng = random.Random(8)
    rows = [(q, " ".join(["common", "often"][: q % 3] + [f"w{rng.randrange(320)}" for _ in range(q % 6)])) for q in range(40)]
    return spark.createDataFrame(rows + [(90, None), (91, "common common often"), (92, "nowhere")], "qid long, query string")


@pytest.mark.parametrize("plain, sent", [(10**9, 200_000), (0, 200_000), (0, 3)])
def test_pruned_search_equals_scoring_all(spark, monkeypatch, questions, plain, sent):
    docs = texts(spark)
    want, shared = rows_of(bm25.bm25(docs, questions, 5).withColumn("score", F.round("score", 6))), rows_of(bm25.token_overlap(docs, questions, 5))
    monkeypatch.setattr(bm25, "PLAIN_PAIRS", plain)
    monkeypatch.setattr(bm25, "SENT_ROWS", sent)
    assert rows_of(bm25.bm25(docs, questions, 5).withColumn("score", F.round("score", 6))) == want
    assert rows_of(bm25.token_overlap(docs, questions, 5)) == shared
    assert len(want) > 150


@pytest.mark.parametrize("plain", [10**9, 0])
def test_batches_equal_a_rebuild(spark, tmp_path, monkeypatch, questions, plain):
    monkeypatch.setattr(bm25, "PLAIN_PAIRS", plain)
    monkeypatch.setattr(inverted, "BLOCK", 16)
    docs = texts(spark)
    whole = inverted.InvertedIndex.open(spark, f"file://{tmp_path}/whole").append(docs, buckets=8)
    index = inverted.InvertedIndex.open(spark, f"file://{tmp_path}/parts")
    assert index.search(questions, 5).count() == 0
    for batch in (docs.filter("id < 100"), docs.filter("id between 50 and 250"), docs.filter("id > 200").unionByName(docs.filter("id % 9 = 0"))):
        index = index.append(batch, buckets=8)
    assert (index.documents, index.average_length) == (whole.documents, whole.average_length)
    score = lambda df: rows_of(df.withColumn("score", F.round("score", 6)))
    want = score(bm25.bm25(docs, questions, 5))
    assert score(index.search(questions, 5)) == score(whole.search(questions, 5)) == want
    assert rows_of(index.overlap(questions, 5)) == rows_of(bm25.token_overlap(docs, questions, 5))
    small = index.compact()
    assert score(small.search(questions, 5)) == want
    held = lambda i: rows_of(i.store.table("postings").select("term", "block", "n", "most_tf", "least_dl"))
    assert held(small) == held(whole) and len(held(index)) > len(held(whole))
    older = inverted.InvertedIndex.open(spark, f"file://{tmp_path}/parts", 1)
    assert older.documents == 100 and score(older.search(questions, 5)) == score(bm25.bm25(docs.filter("id < 100"), questions, 5))


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = inverted.InvertedIndex.open(spark, f"file://{tmp_path}/i").append(texts(spark), buckets=16)
    terms = spark.createDataFrame([("w5",)], "term string")
    found = index._blocks_of(terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = found.select("bucket").first()[0]
    assert f"(bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and f"= {bucket})" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(term,w5)" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert found.select("term").distinct().count() == 1
