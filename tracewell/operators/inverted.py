"""An inverted index that is kept on disk: postings in blocks by term, added to by batches, read by the buckets of the asked terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import bm25
from tracewell.session import materialise, release
from tracewell.sources.commits import Store

#: Postings of a block, about; a term of more documents has them dealt over several by a hash of their ids.
BLOCK = 1024
#: Parts that a bucket's blocks are written in, so a bucket of a hot term is several files.
FILES = 4

_POSTING = "struct<id: string, tf: int, dl: int>"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _laid(postings: DataFrame, df: DataFrame, buckets: int) -> DataFrame:
    """(term, block, n, most_tf, least_dl, postings, bucket) of postings (term, id, tf, dl), in the parts and the order that they are written in.

    df (term, _df) has how many postings terms have. Only terms of more than BLOCK documents are looked up to be dealt; there are at most one
    in BLOCK postings. Postings are dealt once: a part has all of its blocks' postings.
    """
    hot = materialise(df.filter(F.col("_df") > BLOCK).select("term", F.ceil(F.col("_df") / BLOCK).alias("_blocks")), "index-hot")
    placed = postings.join(bm25.sent(hot, hot.count()), "term", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    posting = F.struct("id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")).alias("p")
    tasks = min(buckets * FILES, max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets))
    dealt = placed.select("term", "block", posting, _bucket(F.col("term"), buckets).alias("bucket")).withColumn("_file", F.pmod("block", F.lit(FILES))).repartition(tasks, "bucket", "_file")
    grouped = dealt.groupBy("bucket", "_file", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("p.tf").alias("most_tf"), F.min("p.dl").alias("least_dl"), F.array_sort(F.collect_list("p")).alias("postings"))
    return grouped.sortWithinPartitions("bucket", "term", "block").select("term", "block", "n", "most_tf", "least_dl", "postings", "bucket")


@dataclass(frozen=True)
class InvertedIndex:
    """One version of an index over documents (id, text); searches see that version alone.

    A block has how many postings it holds, the most occurrences and the least length in it: document frequencies are
    sums over blocks, and no part of a score in a block is above that of its most occurrences at its least length.
    Blocks are partitioned by buckets of their terms, and sorted by term in a file.
    """

    store: Store

    @staticmethod
    def open(spark: SparkSession, root: str, version: int | None = None) -> InvertedIndex:
        return InvertedIndex(Store.open(spark, root, version))

    @property
    def documents(self) -> int:
        return self.store.properties.get("documents", 0)

    @property
    def average_length(self) -> float:
        return self.store.properties.get("tokens", 0) / self.documents if self.documents else 0.0

    def _write(self, batch: DataFrame, replace: bool, buckets: int) -> InvertedIndex:
        """batch: rows (id, tokens) of new documents, each once and dealt by id, so that a document is counted where it is."""
        counts = batch.select("id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        some = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
        held = materialise(counts.groupBy("id", "dl").agg(some.alias("terms")), "index-batch")
        df = held.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        laid = _laid(held.select("id", "dl", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "dl"), df, buckets)
        rows = {"postings": laid, "documents": held.select("id", "dl")}
        n, tokens = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        before = {} if replace else self.store.properties
        properties = {"documents": before.get("documents", 0) + n, "tokens": before.get("tokens", 0) + tokens, "buckets": buckets}
        out = self.store.publish(**{"replace" if replace else "append": rows}, properties=properties, partition_by={"postings": ["bucket"]})
        release(held)
        return InvertedIndex(out)

    def append(self, docs: DataFrame, text_col: str = "text", buckets: int = 64) -> InvertedIndex:
        """The index with the documents that it lacks; those whose id it has are left out, as their texts never change. Of rows of one id the first text counts. buckets holds for a new index alone."""
        rows = docs.filter("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.coalesce(text_col, F.lit(""))).alias("_text"))
        if "documents" in self.store.folders:
            ids = materialise(rows.select("id"), "index-ids")
            known = self.store.table("documents").select("id").join(bm25.sent(ids, ids.count()), "id", "left_semi")
            rows = rows.join(known, "id", "left_anti")
        return self._write(rows.select("id", tx.tokens(F.col("_text")).alias("tokens")), False, self.store.properties.get("buckets", buckets))

    def compact(self) -> InvertedIndex:
        """The index with the blocks of all batches put together; what searches give stays the same."""
        rows, buckets = self._blocks_of(None), self.store.properties["buckets"]
        df = rows.groupBy("term").agg(F.sum("n").alias("_df"))
        laid = _laid(rows.select("term", F.explode("postings").alias("p")).select("term", "p.*"), df, buckets)
        return InvertedIndex(self.store.publish(replace={"postings": laid, "documents": self.store.table("documents")}, partition_by={"postings": ["bucket"]}))

    def _blocks_of(self, terms: DataFrame | None) -> DataFrame:
        """Blocks of the terms (term). The folders of other buckets are not read, nor row groups without one of the terms; with over bm25.TERMS of them it is a join."""
        rows = self.store.table("postings")
        if terms is None:
            return rows
        buckets = self.store.properties["buckets"]
        asked = [r.term for r in terms.select("term").distinct().limit(bm25.TERMS + 1).collect()]
        if len(asked) > bm25.TERMS:
            return rows.join(terms.select("term").distinct(), "term", "left_semi")
        at = terms.sparkSession.createDataFrame([(t,) for t in asked], "term string").select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect()
        return rows.filter(F.col("bucket").isin([r.b for r in at]) & F.col("term").isin(asked))

    def _ranked(self, asked: DataFrame, limit: int, overlap: bool) -> DataFrame:
        spark = asked.sparkSession
        if not self.documents:
            return spark.createDataFrame([], f"qid {asked.schema['qid'].dataType.simpleString()}, id string, score double")
        avgdl = self.average_length
        part = lambda tf, dl: F.lit(1.0) if overlap else bm25.tf_part(tf, dl, avgdl)
        blocks = materialise(self._blocks_of(asked).withColumn("bound", part(F.col("most_tf"), F.col("least_dl"))), "index-asked")
        terms = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("bound").alias("most"))
        weight = F.lit(1.0) if overlap else bm25.idf(self.documents, F.col("df")) * F.col("times")
        weights = asked.join(terms.select("term", "df"), "term").select("qid", "term", weight.alias("w"))
        parts = lambda rows: rows.withColumn("p", F.explode("postings")).withColumn("part", part(F.col("p.tf"), F.col("p.dl"))).withColumn("id", F.col("p.id"))

        def fetch(wanted: DataFrame, rows: int) -> DataFrame:
            able = blocks.join(bm25.sent(wanted, rows), "term").filter(F.col("w") * F.col("bound") >= F.col("least"))
            return parts(able).filter(F.col("w") * F.col("part") >= F.col("least")).select("qid", "id", "w", "part")

        def lookup(pairs: DataFrame, rows: int) -> DataFrame:
            few = blocks.join(F.broadcast(pairs.select("term").distinct()), "term", "left_semi") if rows <= bm25.SENT_ROWS else blocks
            return parts(few).select("term", "id", "part").join(bm25.sent(pairs, rows), ["term", "id"]).select("qid", "id", "w", "part")

        return bm25.pruned(weights, terms, fetch, lookup, limit)

    def search(self, queries: DataFrame, limit: int, query_text: str = "query") -> DataFrame:
        """What bm25.bm25 gives for the documents of the index."""
        asked = materialise(bm25.asked_terms(queries, query_text), "index-questions")
        return bm25.top(self._ranked(asked, limit, False), limit, F.round("score", 9).desc(), "id").select("qid", "id", "score", "rank")

    def overlap(self, queries: DataFrame, limit: int, query_text: str = "query") -> DataFrame:
        """What bm25.token_overlap gives for the documents of the index."""
        asked = materialise(bm25.asked_terms(queries, query_text), "index-questions")
        return bm25.overlaps(self._ranked(asked, limit, True), limit)
