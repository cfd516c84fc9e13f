"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, collocations, decontam, edit_counts, exact_dedup, jaccard_join, langid, periodic_runs, secrets_scan, simhash_join, surrogates, url_rules, warc

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), VOCABULARY)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.find_secrets(_table(spark, sf_dir, "documents"), VOCABULARY)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    base = F.sha2(joined(F.filter("spans", lambda s: s.kind != "random")).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("text_hash")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()))
    predicted = langid.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
    return predicted.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits: an insertion, a deletion and a replacement at the quarters of its text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    edit = lambda place, removed, inserted: F.struct(F.floor(n * place / 4).cast("int").alias("position"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(1, 0, " edited's"), edit(2, 7, ""), edit(3, 5, "  New\n"))
    return edit_counts.count_edited(docs.withColumn("edits", edits), VOCABULARY)


#: The query's key. A job that publishes its texts passes a secret one.
SURROGATE_KEY = b"tracewell"


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = surrogates.pseudonymise(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e.kind, e.start, e.end)), ",")
    return made.select("doc_id", F.size("entities").cast("long").alias("n_entities"), spans.alias("spans"), "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def repeated_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """A tenth of the documents repeat a stretch from some word on: the original word that stands at each place; null ids and others none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % period)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), places=repeated_places)
    best = F.expr("aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    made = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    exponent = F.expr("1000 * _b.length div _b.period").alias("exponent_milli")
    return made.select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period", exponent, "runs_sha256", "collapsed_sha256")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_join.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""

#: Every sequence of words is spelled out and counted; parts and longer phrases are found by their spelling.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
f AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])))) AS phrase FROM lists
  ) GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT lang, phrase AS p, f AS a FROM f WHERE len(phrase) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM c),
scored AS (
  SELECT cuts.lang, p, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p[1:k] JOIN f y ON y.lang = cuts.lang AND y.phrase = p[k + 1:len(p)]
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, a, unnest(flatten(list_transform(range(2, len(p)), lambda k: list_transform(range(1, len(p) - k + 2), lambda i: p[i:i + k - 1])))) AS q FROM c WHERE len(p) > 2),
absorbed AS (SELECT DISTINCT c.lang, c.p FROM c JOIN inside i ON i.lang = c.lang AND i.q = c.p WHERE 100::HUGEINT * i.a >= 80::HUGEINT * c.a),
kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM best ANTI JOIN absorbed USING (lang, p))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""


#: Digests in base32 from their bits; equal payloads as windows.
OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
bits AS (SELECT page_id, h, first, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: right('000' || bin(('0x' || c)::INT), 4)), '') AS b FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_prepend(0, list_transform(string_split(substr(b, (5 * i + 1)::INT, 5), ''), lambda x: x::INT)), lambda n, x: 2 * n + x) + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM bits
"""

#: Pairs meet on every shingle; components by reachability.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1) + 1)), lambda i: w[i:i + 4])) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS seen FROM ways UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.seen)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""

#: The checksum by its table; equal words at every distance as islands.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM documents, crc),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, h // 10 % greatest(len(w), 1) AS a, h // 10 % 8 AS k FROM d),
m AS MATERIALIZED (SELECT doc_id, n, CASE WHEN changed THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END + 1]) ELSE w END AS w FROM g),
word AS MATERIALIZED (SELECT doc_id, n, i - 1 AS i, w[i] AS x FROM m, unnest(range(1, n + 1)) r(i)),
same AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // 3),
stretch AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same) GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
run AS MATERIALIZED (SELECT doc_id, s, length, min(p) AS p FROM stretch GROUP BY doc_id, s, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / p DESC, s, p) = 1),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(s + p, s + length)) r(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, p AS period, 1000 * length // p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN said USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


_QUERIES = (op1_warc, op2_byte_bpe, op3_secrets, op4_exact_dedup, op5_language_id, op6_url_rules, op7_jaccard_join, op8_edit_counts, op9_surrogates, op10_decontamination, op11_collocations, op12_periodic_runs, op13_simhash_dedup)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_url_rules": url_rules.judge_urls_sql(), "op7_jaccard_join": OP7_SQL, "op11_collocations": OP11_SQL, "op12_periodic_runs": OP12_SQL}
