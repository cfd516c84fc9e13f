"""Phrases whose words occur together more than apart, from exact counts of all word sequences.

1. Words are counted by language. Those that occur often enough to be in a phrase get numbers (`frequent_words`): by one
   order over all languages, so a number names the language too.
2. Texts are encoded with these numbers. Pieces break at all other words, as no phrase spans them. Every
   place of a piece gives a key of 16 bytes: the numbers of its word and of the three that follow, 0 beyond the
   piece's end. A task sorts its keys and sends each distinct one with a count (`_packed`).
3. Keys are cut into ranges of about equal size, sorted in a range by their 16-bit digits, and counted as runs. As a phrase is a prefix of its keys, one sort counts phrases of two, three and four words
   (`_count_range`). What a range has of a phrase at its edges is summed with its neighbours.
4. A phrase's parts and the phrases around it are looked up by joins over the counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import arrays
from tracewell.llm.grouping import SALTS, attach
from tracewell.operators.blocks import numbered
from tracewell.session import materialise

#: Bytes of text of one language that are encoded at a time (a longer document is one part).
CHUNK_BYTES = 2_000_000
#: Keys that a task sorts at a time, and that a range holds, about.
KEYS = 1 << 19
#: Ranges at most; beyond it they grow. The driver holds SAMPLES keys a range, or LEAST_SAMPLE, of one text in SAMPLED to cut them; the cuts balance the ranges and decide no count.
SAMPLED = 8
RANGES = 1 << 20
SAMPLES = 4
LEAST_SAMPLE = 1 << 16
#: A dictionary of at most so many words and bytes (counted) is sent to all tasks; a larger one is joined.
DICTIONARY_WORDS = 1_000_000
DICTIONARY_BYTES = 32_000_000

#: The characters that end a piece, and those that separate words in it.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"

_BREAK = np.isin(np.arange(256), list(BREAKS))
_GAP = np.isin(np.arange(256), list(BREAKS + SPACES))
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """Of rows (lang, text): the language, the words as numbers of their own, whether each starts a piece, and the distinct words."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            data, offsets = arrays.string_buffers(batch.column(1).filter(pc.equal(langs.indices, code)))
            for i, j in arrays.chunks(offsets, CHUNK_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a, b, doc = arrays.words(part, at, _GAP)
                if not len(a):
                    continue
                piece = np.cumsum(_BREAK[part], dtype=np.int32 if len(part) < 1 << 31 else np.int64)[a]
                fresh = np.ones(len(a), bool)
                fresh[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
                ids, words = arrays.distinct_ranges(arrays.lowered(part[~_GAP[part]]), b - a)
                yield lang, ids, fresh, words.cast(pa.large_string())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and for each chunk its number of words under a null word."""
    for lang, ids, _, words in _chunks(batches):
        n = np.append(np.bincount(ids), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([*words.to_pylist(), None], pa.string()), pa.array(n)], names=["lang", "word", "n"])


def frequent_words(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n, id) of all words that occur least times in their language, numbered from 1 by falling counts, and (lang, total) of all words."""
    counts = texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kept = materialise(counts.filter((F.col("n") >= least) | F.col("word").isNull()), "collocations-words")
    words = materialise(numbered(kept.filter("word is not null"), F.desc("n"), "lang", "word").withColumnRenamed("place", "id"), "collocations-dictionary")
    return words, kept.filter("word is null").select("lang", F.col("n").alias("total"))


def _sorted_keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of keys (high, low), by a radix sort over those of their 16-bit digits that differ."""
    order = np.arange(len(high))
    for half in (low, high):
        some = int(np.bitwise_or.reduce(half)) if len(half) else 0
        for shift in (0, 16, 32, 48):
            if some >> shift & 0xFFFF:
                digit = (half >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _summed(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their n."""
    order = _sorted_keys(high, low)
    high, low, n = high[order], low[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    return high[at], low[at], np.add.reduceat(n, at) if len(at) else n


def _keys(ids: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all places that have a second word; ids are 0 for words that are not frequent."""
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(3, np.uint64)])
    linked = (ids[:-1] > 0) & (ids[1:] > 0) & np.concatenate([~fresh[1:], np.zeros(3, bool)])
    n = len(fresh)
    two = linked[:n]
    three = two & linked[1 : n + 1]
    four = three & linked[2 : n + 2]
    low = (ids[2 : n + 2] * three << _HALF) | (ids[3 : n + 3] * four)
    return (ids[:n] << _HALF | ids[1 : n + 1])[two], low[two]


_PACKED = "part long, high binary, low binary, n binary"


def _cut(cuts: tuple[np.ndarray, np.ndarray], high: np.ndarray, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Sorted keys as a row for each range between the cuts."""
    a, b = np.searchsorted(high, cuts[0], side="left"), np.searchsorted(high, cuts[0], side="right")
    ends = np.array([0, *[i + np.searchsorted(low[i:j], y) for i, j, y in zip(a.tolist(), b.tolist(), cuts[1])], len(high)], np.int64)
    parts = np.flatnonzero(ends[1:] > ends[:-1])
    columns = [pa.array([x[ends[p] : ends[p + 1]].tobytes() for p in parts], pa.binary()) for x in (high, low, n.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *columns], names=["part", "high", "low", "n"])


def _packed(cuts: tuple[np.ndarray, np.ndarray]):
    """Of (ids, fresh) the distinct keys of about KEYS keys at a time, with counts, sorted and cut."""

    def run(sequences: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, fresh in sequences:
            held.append(_keys(ids, fresh))
            if sum(len(h) for h, _ in held) >= KEYS:
                high, low = (np.concatenate(x) for x in zip(*held))
                held = []
                yield _cut(cuts, *_summed(high, low, np.ones(len(high), np.int64)))
        if held:
            high, low = (np.concatenate(x) for x in zip(*held))
            yield _cut(cuts, *_summed(high, low, np.ones(len(high), np.int64)))

    return run


def _sampled(stride: int):
    """Every stride-th of the distinct keys of (ids, fresh), from a start that follows from them."""

    def run(sequences: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for ids, fresh in sequences:
            high, low = _keys(ids, fresh)
            high, low, _ = _summed(high, low, np.ones(len(high), np.int64))
            at = slice(int(arrays.mix(low.sum(keepdims=True))[0]) % stride if len(low) else 0, None, stride)
            yield pa.RecordBatch.from_arrays([pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64))], names=["high", "low"])

    return run


def _known(dictionary: pa.Table, send):
    """Encodes texts with a dictionary that every task holds, and sends what send makes of them."""
    of = {lang: dictionary.filter(pc.equal(dictionary["lang"], lang)) for lang in dictionary["lang"].unique().to_pylist()}
    value = {lang: (t["word"].combine_chunks().cast(pa.large_string()), np.append(t["id"].to_numpy(), 0)) for lang, t in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequences() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lang, ids, fresh, words in _chunks(batches):
                if lang in value:
                    known, number = value[lang]
                    at = pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False)
                    yield number[at][ids], fresh

        yield from send(sequences())

    return run


def _own_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in numbers of their own: (lang, codes, words); a code is twice the number, plus 1 at the start of a piece."""
    for lang, ids, fresh, words in _chunks(batches):
        codes = (ids * 2 + fresh).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), pa.array([words.to_pylist()], pa.list_(pa.string()))], names=["lang", "codes", "words"])


def _renumbered(send):
    """Encodes chunks (codes, found), found naming the dictionary's number for numbers of the chunk's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequences() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for raw, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                    codes = np.frombuffer(raw, np.uint32)
                    number = np.zeros(int(codes.max() >> 1) + 1, np.int64)
                    number[found.values.field("at").to_numpy()] = found.values.field("id").to_numpy()
                    yield number[codes >> 1], (codes & 1).astype(bool)

        yield from send(sequences())

    return run


def _encoded(texts: DataFrame, words: DataFrame, n: int, size: int):
    """What makes rows of a schema of all texts, given what is to be sent of them."""
    if n <= DICTIONARY_WORDS and size <= DICTIONARY_BYTES:
        held = words.select("lang", "word", "id").toArrow()
        return lambda rows, send, schema: rows.mapInArrow(_known(held, send), schema)

    def joined(rows: DataFrame, send, schema: str) -> DataFrame:
        chunks = materialise(rows.mapInArrow(_own_numbers, "lang string, codes binary, words array<string>").withColumn("chunk", F.monotonically_increasing_id()), "collocations-chunks")
        each = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"])
        found = each.groupBy("chunk").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "id")).alias("found"))  # a chunk's distinct words
        return chunks.join(found, "chunk").select("codes", "found").mapInArrow(_renumbered(send), schema)

    return joined


def _count_range(least: int):
    """Phrases of a range (high, low, a), the numbers of absent words 0: those of least occurrences, and any at the range's edges."""

    def counted(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        high, low, n = _summed(high, low, n.astype(np.int64))
        out = []
        for length in (2, 3, 4):
            last = {2: low & np.uint64(0), 3: low & (_LOW << _HALF), 4: low}[length]
            there = np.ones(len(low), bool) if length == 2 else low >> _HALF > 0 if length == 3 else low & _LOW > 0
            at = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (last[1:] != last[:-1])]))
            a = np.add.reduceat(n, at)
            keep = (a >= least) | ((length < 4) & ((at == 0) | (at == at[-1])))
            keep &= there[at]
            out.append((high[at][keep], last[at][keep], a[keep]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out)], names=["high", "low", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for this, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if this != part and held:
                    yield counted(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                part = this
                held.append([np.frombuffer(x, kind) for x, kind in zip(row, (np.uint64, np.uint64, np.uint32))])
        if held:
            yield counted(*(np.concatenate(x) for x in zip(*held)))

    return run


def phrase_counts(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(high, low, a) of all phrases of 2 to 4 words that occur least times within pieces, for rows (lang, text)."""
    spark = texts.sparkSession
    n, size, most, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)), F.max("id"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if (most or 0) >= 1 << 32:
        raise ValueError("more frequent words than numbers of 32 bits")
    encode = _encoded(texts, words, n, size)
    ranges = min(RANGES, max(1, -(-total // KEYS)))  # keys start at frequent words
    cuts = (np.zeros(0, np.uint64),) * 2
    if ranges > 1:
        some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
        sample = encode(some, _sampled(max(1, total // (SAMPLED * max(LEAST_SAMPLE, SAMPLES * ranges)))), "high long, low long").toArrow()
        high, low = (sample[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        order = np.lexsort((low, high))
        at = order[np.arange(1, ranges) * len(order) // ranges] if len(order) else order
        cuts = tuple(np.array(x, np.uint64) for x in zip(*sorted(set(zip(high[at].tolist(), low[at].tolist()))))) if len(at) else cuts
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(ranges, 1 << 16))
    dealt = encode(texts, _packed(cuts), _PACKED).repartition(tasks, "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(_count_range(least), "high long, low long, a long").groupBy("high", "low").agg(F.sum("a").alias("a"))
    return materialise(found.filter(F.col("a") >= least), "collocations-phrases")


def _word(n: int) -> Column:
    """The number of the n-th word, from 1, of the phrase (high, low); 0 if it has fewer."""
    of = F.col("high" if n < 3 else "low")
    return F.shiftrightunsigned(of, 32) if n % 2 else of.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _key(*words: Column) -> Column:
    w = [*words, *[F.lit(0).cast("long")] * (4 - len(words))]
    return F.struct(F.shiftleft(w[0], 32).bitwiseOR(w[1]).alias("high"), F.shiftleft(w[2], 32).bitwiseOR(w[3]).alias("low"))


def _by_length(make) -> Column:
    """make(length) for the phrase's own length."""
    return F.when(F.col("low") == 0, make(2)).when(_word(4) == 0, make(3)).otherwise(make(4))


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with l, r and score of their lowest-scoring cut.

    The parts of all cuts are looked up together; a part of many phrases has them dealt by salts.
    """
    known = phrases.select(F.struct("high", "low").alias("part"), "a").unionByName(words.select(_key(F.col("id")).alias("part"), F.col("n").alias("a")))
    sides = lambda length, k: [(k, 0, [_word(i) for i in range(1, k + 1)]), (k, 1, [_word(i) for i in range(k + 1, length + 1)])]
    parts = lambda length: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _key(*w).alias("part")) for c in range(1, length) for k, side, w in sides(length, c)])
    each = phrases.select(F.struct("high", "low").alias("phrase"), "a", F.explode(_by_length(parts)).alias("_p")).select("phrase", "a", "_p.*")
    found = attach(each, "part", "phrase", {"_c": F.count(F.lit(1))}, {"_c": F.sum("_c")}, lambda keys: keys.select("part").join(known.withColumnRenamed("a", "f"), "part"))
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"f{k}{side}")
    wide = found.groupBy("phrase", "a").agg(*[at(k, side) for k in (1, 2, 3) for side in (0, 1)])
    score = lambda k: F.expr(f"(cast(a as decimal(20, 0)) * 2000000) div (cast(f{k}0 as decimal(20, 0)) + f{k}1)")
    best = F.array_min(F.filter(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")) for k in (1, 2, 3)]), lambda c: c.score.isNotNull()))
    return wide.withColumn("_b", best).select("phrase.high", "phrase.low", "a", "_b.l", "_b.r", "_b.score")


def _not_absorbed(scored: DataFrame, phrases: DataFrame) -> DataFrame:
    """Without the phrases that lie in a longer one which occurs at least 80 times for each 100 of theirs (5 * longer >= 4 * a)."""
    inside = lambda length: F.array(*[_key(*[_word(i) for i in range(s, s + n)]) for n in range(2, length) for s in range(1, length - n + 2)])
    longer = phrases.filter("low <> 0").select(F.explode(F.when(_word(4) == 0, inside(3)).otherwise(inside(4))).alias("_p"), "a")
    most = longer.groupBy("_p").agg(F.max("a").alias("_most")).select("_p.*", "_most")
    return scored.join(most, ["high", "low"], "left").filter(F.coalesce(5 * F.col("_most") < 4 * F.col("a"), F.lit(True))).drop("_most")


def _spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with lang and their words joined by spaces."""
    rows = found.withColumn("_key", F.struct("high", "low"))
    each = rows.select("_key", F.posexplode(_by_length(lambda n: F.array(*[_word(i) for i in range(1, n + 1)]))).alias("at", "id"))
    named = attach(each, "id", "_key", {"_c": F.count(F.lit(1))}, {"_c": F.sum("_c")}, lambda ids: ids.select("id").join(words.select("id", "lang", "word"), "id"))
    spelled = named.groupBy("_key").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("_w"))  # four words at most
    return rows.join(spelled.select("_key", "lang", F.array_join("_w.word", " ").alias("phrase")), "_key").drop("_key")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000) -> DataFrame:
    """The top phrases of each language by how firmly their words belong together.

    A-Z are lower-cased; a text is cut into pieces at [.,;:!?\\x0A-\\x0D] and those into words [^\\x20\\x09]+. n counts a
    language's words, f(phrase) its occurrences within pieces, overlaps included. Phrases of 2 to 4 words with a = f(phrase) >= least
    are cut into two parts; l and r are the counts of the parts, and the score is floor(2000000 * a / (l + r)) of the lowest-scoring
    cut (of equal ones the first). A phrase inside a longer one with 100 * f(longer) >= 80 * a goes.
    Returns lang, rank, phrase, a, l, r, n, score, by score and a, both falling, then by the phrase's bytes. A null language
    is `und`; a null text is empty; repeated rows count each time; other columns are left out; an empty table, or one without
    frequent phrases, gives an empty table. Counts are exact and over all rows.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, totals = frequent_words(texts, least)
    phrases = phrase_counts(texts, words, least)
    found = _spelled(_not_absorbed(_scored(phrases, words), phrases), words)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *of: F.row_number().over(Window.partitionBy("lang", *of).orderBy(*order))
    near = found.withColumn("_salt", F.pmod(F.xxhash64("high", "low"), F.lit(SALTS))).withColumn("rank", place("_salt")).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", place()).filter(F.col("rank") <= top)
    one = totals.groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(one, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
