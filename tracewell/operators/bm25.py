"""BM25 and shared words for many queries in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.session import materialise, release

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
#: Distinct terms of all questions that go along with the plan.
TERMS = 20_000
#: Rows (counted) up to which one side of a join is sent to all tasks.
SENT_ROWS = 200_000
#: Pairs of a question and a posting (counted beforehand) up to which all are scored; beyond it documents that cannot be among the best are left out first.
PLAIN_PAIRS = 20_000_000
#: Scores this near to a bound are not left out, so that rounding decides nothing.
MARGIN = 1e-6


def tf_part(tf: Column, dl: Column, avgdl: float) -> Column:
    """What one occurrence weight of a term is multiplied with: grows with tf, shrinks with the length dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or None)))


def idf(n: int, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _held(docs: DataFrame, asked: DataFrame, doc_text: str) -> DataFrame:
    """(id, dl, hits) of every document: its length in tokens, and those of its tokens that are asked for (term).

    Texts are tokenised once, and what is written to the shared folder has the terms of the questions alone. A
    set of terms over TERMS (counted) does not go along with the plan; then all tokens are written and joined later.
    """
    tokens = docs.select(F.col("id").cast("string").alias("id"), tx.tokens(F.col(doc_text)).alias("tokens"))
    terms = asked.select("term").distinct().limit(TERMS + 1).collect()
    wanted = F.col("tokens")
    if len(terms) <= TERMS:
        wanted = F.filter("tokens", lambda t: t.isin([r.term for r in terms]))
    return materialise(tokens.select("id", F.size("tokens").alias("dl"), wanted.alias("hits")), "bm25-tokens")


def asked_terms(queries: DataFrame, query_text: str = "query") -> DataFrame:
    """(qid, term, times) of queries (qid, query)."""
    return queries.select("qid", F.explode(tx.tokens(F.col(query_text))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to all tasks where its counted rows are few."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def pruned(weights: DataFrame, terms: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], lookup: Callable[[DataFrame, int], DataFrame], limit: int) -> DataFrame:
    """(qid, id, score): every document that may be one of the limit best of a question, with its whole score.

    weights (qid, term, w): what a term counts for; terms (term, df, most): its documents, and the largest part a
    document has of it. fetch gives (qid, id, w, part) of postings whose w * part reaches a column least; lookup gives them
    for rows (qid, id, term, w). The second argument of both is the number of rows they get.

    The rarest terms give first documents, and the whole scores of the best of them a score that the best
    reach surely (floor). Terms that together stay under the floor bring no document in: the common ones are taken for that
    first, and are looked up for the documents of the other terms alone.
    """
    w = materialise(weights.join(terms, "term").withColumn("u", F.col("w") * F.col("most")), "ranked-weights")
    n_weights, pairs = w.agg(F.count(F.lit(1)), F.sum("df")).first()
    scored = lambda rows: rows.groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))
    if (pairs or 0) <= PLAIN_PAIRS:
        return scored(fetch(w.select("qid", "term", "w", F.lit(0.0).alias("least")), n_weights))
    of = Window.partitionBy("qid").orderBy("df", "term")
    rare = w.withColumn("_before", F.coalesce(F.sum("df").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < 4 * limit)
    some = top(scored(fetch(rare.select("qid", "term", "w", F.lit(0.0).alias("least")), n_weights)), 2 * limit, F.col("score").desc(), "id").select("qid", "id")
    some = materialise(some.join(w.select("qid", "term", "w"), "qid"), "ranked-some")
    floors = top(scored(lookup(some, some.count())), limit, F.col("score").desc(), "id").filter(F.col("rank") == limit).select("qid", (F.col("score") - MARGIN).alias("floor"))
    falling = Window.partitionBy("qid").orderBy(F.desc("df"), "term")
    total = F.sum("u").over(Window.partitionBy("qid"))
    marked = w.join(floors, "qid", "left").withColumns({"floor": F.coalesce("floor", F.lit(0.0)), "upto": F.sum("u").over(falling), "all": total})
    marked = materialise(marked.withColumn("common", F.col("upto") < F.col("floor")).withColumn("least", F.col("floor") - (F.col("all") - F.col("u"))), "ranked-terms")
    rest = marked.filter("common")
    late = rest.groupBy("qid").agg(F.sum("u").alias("_more"))
    first = scored(fetch(marked.filter("not common").select("qid", "term", "w", "least"), n_weights)).join(F.broadcast(late) if n_weights <= SENT_ROWS else late, "qid", "left")
    first = first.join(sent(floors, n_weights), "qid", "left").filter(F.col("score") + F.coalesce("_more", F.lit(0.0)) >= F.coalesce("floor", F.lit(0.0)))
    first = materialise(first.select("qid", "id", "score"), "ranked-first")
    added = materialise(first.select("qid", "id").join(sent(rest.select("qid", "term", "w"), n_weights), "qid"), "ranked-added")
    out = first.unionByName(scored(lookup(added, added.count()))).groupBy("qid", "id").agg(F.sum("score").alias("score"))
    out = materialise(out, "ranked")
    release(w, some, marked, first, added)
    return out


def over_rows(postings: DataFrame):
    """fetch and lookup over postings (term, id, part)."""

    def fetch(weights: DataFrame, rows: int) -> DataFrame:
        return postings.join(sent(weights, rows), "term").filter(F.col("w") * F.col("part") >= F.col("least")).select("qid", "id", "w", "part")

    def lookup(pairs: DataFrame, rows: int) -> DataFrame:
        return postings.join(sent(pairs, rows), ["term", "id"]).select("qid", "id", "w", "part")

    return fetch, lookup


def bm25(docs: DataFrame, queries: DataFrame, limit: int, doc_text: str = "text", query_text: str = "query") -> DataFrame:
    """(qid, id, score, rank) of the limit best documents (id, text) for each query (qid, query).

    Statistics cover all documents, those without tokens too. A term counts as often as the query has it.
    Ties go to the smaller id as a string.
    """
    asked = materialise(asked_terms(queries, query_text), "bm25-asked")
    held = _held(docs, asked, doc_text)
    n, avgdl = held.agg(F.count(F.lit(1)), F.avg("dl")).first()
    counts = held.select("id", "dl", F.explode("hits").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    postings = materialise(counts.select("term", "id", tf_part(F.col("tf"), F.col("dl"), avgdl).alias("part")), "bm25-postings")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    weights = asked.join(terms.select("term", "df"), "term").select("qid", "term", (idf(n, F.col("df")) * F.col("times")).alias("w"))
    scores = pruned(weights, terms, *over_rows(postings), limit)
    return top(scores, limit, F.round("score", 9).desc(), "id").select("qid", "id", "score", "rank")


def top(scores: DataFrame, limit: int, *order, by: str = "qid") -> DataFrame:
    """The first limit rows of each query in this order, with rank from 1."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)


def overlaps(scores: DataFrame, limit: int) -> DataFrame:
    return top(scores.select("qid", "id", F.round("score").cast("long").alias("overlap")), limit, F.col("overlap").desc(), "id")


def token_overlap(docs: DataFrame, queries: DataFrame, limit: int, doc_text: str = "text", query_text: str = "query") -> DataFrame:
    """(qid, id, overlap, rank): documents by how many distinct tokens they share with a query, then id."""
    asked = materialise(asked_terms(queries, query_text), "overlap-asked")
    held = _held(docs, asked, doc_text)
    postings = materialise(held.select("id", F.explode(F.array_distinct("hits")).alias("term")).distinct().withColumn("part", F.lit(1.0)), "overlap-postings")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.lit(1.0).alias("most"))
    return overlaps(pruned(asked.select("qid", "term", F.lit(1.0).alias("w")), terms, *over_rows(postings), limit), limit)


def postings(docs: DataFrame) -> DataFrame:
    """(token, id): the distinct tokens of each document, the table that an index persists."""
    return docs.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"), "id")


def search_facts(facts: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """BM25 over valid facts, whose text is the key in words and the value."""
    texts = facts.filter("valid_to is null").select("id", F.concat(F.translate("key", "_", " "), F.lit(" "), "value").alias("text"))
    return bm25(texts, queries, limit)
