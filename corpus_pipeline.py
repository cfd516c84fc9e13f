"""A corpus pipeline out of the text operators: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, exact_dedup, jaccard_join, langid, queries
from tracewell.session import materialise, shared_dir


#: Bytes of the batches that stages send to Python and get back. Texts are long, and a task holds a batch, what is made of it and both their copies in the JVM.
BATCH_BYTES = 4 << 20


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with batches of BATCH_BYTES at most in its session (a single longer row is a batch)."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letters, or several codewords as near and none likely.

    A document in two languages is ambiguous too, but one of them is half likely, so it stays. Null texts have
    no letters and go; repeated rows stay repeated.
    """
    model = langid.fit(docs.filter(~queries.held_out()))
    if set(langid.MADE).isdisjoint(docs.columns):
        return told(langid.predict(docs, model)).select(*docs.columns)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return told(langid.predict(whole, model, keep=["_doc"])).select("_doc.*")


def told(predicted: DataFrame) -> DataFrame:
    """The rows whose language can be told: that is known, and not ambiguous unless it is half likely."""
    return predicted.filter(f"lang_pred <> '{langid.UNKNOWN}' and not (ambiguous and score < 0.5)")


@bounded
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays. Null texts are empty; repeated rows are equal; a null id gives way to others."""
    return _of_keys(docs, lambda keyed: exact_dedup.exact_dedup(keyed).filter("kept").select("doc_id"))


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity the one with the smallest id stays, a null id after all others; of repeated rows one. Texts without words are linked with nothing."""
    return _of_keys(docs, lambda keyed: jaccard_join.jaccard_components(keyed).filter("doc_id = component_id").select("doc_id").distinct())


def _of_keys(docs: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of each key that choose picks from rows (doc_id, text) whose doc_id is that key: the row's id, nulls last, and its text's digest.

    So a row goes or stays by its own text where an id occurs with several.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    kept = materialise(choose(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("_kept")), "kept-keys")
    name = "_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, key)
    return keyed.join(kept, keyed[name].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates([name]).select(*docs.columns)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark; null and empty texts have none and stay, as do repeated rows."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the offsets that decoding a part needs; a null text is empty. Repeated rows stay repeated, other columns go."""
    return bpe.encode(docs, queries.VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the stages (learned classifier, tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table; each one's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
