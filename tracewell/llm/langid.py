"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a logistic regression over hashed character n-grams, learned
from texts relabelled by that bit, predicts whether the text's language has it set; the codeword with the
least weighted loss wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import arrays
from tracewell.llm.grouping import SALTS, join_counted
from tracewell.llm.pretokens import classes
from tracewell.session import materialise

#: Labelled texts of a language that a model is fitted on, at most: of each part of its ids those that hash lowest.
SAMPLE = 1536
#: Of these, one in so many is held back from learning, to weigh the bits and scale the margins.
CALIBRATE_EVERY = 4
#: Texts that one task learns from; tasks start each of ROUNDS from the mean of what all have learned, and pass EPOCHS times over their texts.
PART_TEXTS, ROUNDS, EPOCHS, BATCH = 128, 2, 2, 32
START, RATE, SHRINK = 20.0, 1.0, 1e-5
#: Each text is learned from as a whole and by excerpts of so many code points, so that short texts are told too.
EXCERPTS = (40, 12)
#: Languages up to here have all codewords that tell any two apart; more have so many random bits.
EXHAUSTIVE, BITS = 6, 63
FEATURES = 1 << 15
#: A text is ambiguous where the losses of the best two languages differ by less than this part of the worst's.
AMBIGUOUS = 0.02
UNKNOWN = "und"
#: Bytes of text at a time: a code point takes a row of weights, so passes are shorter than elsewhere.
CHUNK_BYTES = 200_000
ORDERS = (1, 2, 3)
#: Columns of a prediction.
MADE = ("lang_pred", "score", "ambiguous")


def codewords(n: int) -> np.ndarray:
    """Codewords (n x bits of -1, +1): every split of the languages in two, or well spread random ones."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        bits = [[1] + [1 if m >> i & 1 else -1 for i in range(n - 1)] for m in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    best, random = None, np.random.default_rng(7)
    for _ in range(64):
        code = random.choice(np.array([-1, 1], np.int8), (n, BITS))
        code[0], code[1] = np.where((code == code[0]).all(axis=0), -code[0], code[0]), code[1]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of each order from every code point on; offsets of the documents; letters of each."""
    cp, at = arrays.code_points(data)
    edges = np.searchsorted(at, offsets)
    letter = classes()[cp] == 0
    x = np.where(letter, cp, 32).astype(np.uint32)  # what is no letter separates
    out, acc = [], np.zeros(len(x), np.uint32)
    for order in ORDERS:
        shifted = np.full(len(x), 32, np.uint32)
        shifted[: len(x) - order + 1] = x[order - 1 :]
        for back in range(1, order):  # what follows a document's last code points is another's
            last = edges[1:] - back
            shifted[last[last >= edges[:-1]]] = 32
        acc = acc * np.uint32(0x9E3779B1) + shifted + np.uint32(order)
        mixed = acc ^ (acc >> np.uint32(15))
        mixed *= np.uint32(0x85EBCA6B)
        out.append((mixed >> np.uint32(17)).astype(np.int32))
    letters = np.concatenate([[0], np.cumsum(letter)])
    return out, edges, letters[edges[1:]] - letters[edges[:-1]]


@dataclass
class Model:
    """languages; codewords; weights (features x bits), bias and scale of each bit; weight of each language's bits."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight of the n-grams of each document, per bit; letters of each."""
        grams, edges, letters = _grams(data, offsets)
        total = np.zeros((len(edges) - 1, self.weights.shape[1]), np.float64)
        full = np.flatnonzero(edges[:-1] < edges[1:])
        if len(full):
            for g in grams:
                total[full] += np.add.reduceat(self.weights[g], edges[:-1][full], axis=0, dtype=np.float64)
        return total / np.maximum(1, len(ORDERS) * np.diff(edges))[:, None], letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language of each row, a score from 0 to 1, and whether it is ambiguous."""
        signed = np.clip(margins * self.scale, -12, 12)
        loss = np.stack([(np.log1p(np.exp(-signed * c)) * t).sum(axis=1) for c, t in zip(self.code, self.trust)], axis=1)
        best = loss.argmin(axis=1)
        if loss.shape[1] == 1:
            return best, np.ones(len(best)), np.zeros(len(best), bool)
        likely = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        two = np.partition(loss, 1, axis=1)
        return best, likely.max(axis=1) / likely.sum(axis=1), two[:, 1] - two[:, 0] < AMBIGUOUS * loss.max(axis=1)


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(_id, _lang, _text) of at most sample labelled texts of each language, one a document id."""
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang")).filter("_id is not null and _lang is not null")
    part = labelled.distinct().withColumn("_salt", F.pmod(F.hash("_id"), F.lit(SALTS)))
    turn = F.row_number().over(Window.partitionBy("_lang", "_salt").orderBy(F.xxhash64("_id"), "_id"))
    chosen = materialise(part.withColumn("_turn", turn).filter(F.col("_turn") <= max(1, sample // SALTS)).select("_id", "_lang"), "langid-sample")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    return join_counted(texts, chosen, ["_id", "_lang"], "inner", chosen.count()).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))


def _features(texts: pa.Array, excerpt: int | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Share of each hashed n-gram among all of each text, or of an excerpt of so many code points from some place of it."""
    out = np.zeros((len(texts), FEATURES), np.float32) if out is None else out
    data, offsets = arrays.string_buffers(texts)
    for low, high in arrays.chunks(offsets, CHUNK_BYTES):
        grams, edges, _ = _grams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        for d in range(high - low):  # each text counts alike, whatever its length
            n = int(edges[d + 1] - edges[d])
            if n:
                size = min(n, excerpt or n)
                start = edges[d] + n * 7919 % (n - size + 1)
                for g in grams:
                    out[low + d] += np.bincount(g[start : start + size], minlength=FEATURES) / (size * len(ORDERS))
    return out


def learn(x: np.ndarray, target: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights (features x bits) after EPOCHS passes of logistic regression, of each bit on its own labels (-1, +1), from weights on; the mean over the last pass.

    The rows of x are brought to length 1 in place.
    """
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    w, mean, steps = weights.copy(), np.zeros_like(weights), 0
    random = np.random.default_rng(11)
    for epoch in range(EPOCHS):
        order = random.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            part, y = x[rows], target[rows]
            slope = -y / (1 + np.exp(np.clip(y * (part @ w), -30, 30)))
            w -= RATE * (part.T @ slope / len(rows) + SHRINK * w)
            if epoch == EPOCHS - 1:
                mean += w
                steps += 1
    return mean / steps if steps else w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most sample texts of each language of docs (see SAMPLE); rows with null id or language are left out.

    Tasks learn every bit from their share of the sampled whole texts, by parameter mixing; their
    weights are written to the shared folder and come to the driver one task's at a time.
    """
    held = _sample(docs, id_col, text_col, lang_col, sample).withColumns({"_key": F.xxhash64("_id"), "_check": F.pmod(F.xxhash64(F.lit("check"), "_id"), F.lit(CALIBRATE_EVERY)) == 0})
    held = materialise(held.drop("_id"), "langid-texts")
    languages = held.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()
    names = sorted(r["_lang"] for r in languages)
    if not names:
        return Model([], np.ones((0, 1), np.int8), np.zeros((FEATURES, 1), np.float32), np.ones(1), np.ones((0, 1)))
    number = {x: i for i, x in enumerate(names)}
    code = codewords(len(names))
    parts = -(-sum(r["n"] for r in languages) // PART_TEXTS)
    train = held.filter("not _check").withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), "_key"), F.lit(parts))).select("_part", "_lang", "_key", "_text")

    def count(table: pa.Table) -> pa.Table:
        total = np.zeros((len(names), FEATURES))
        for b in table.to_batches(max_chunksize=64):
            np.add.at(total, [number[lang] for lang in b.column(1).to_pylist()], _features(b.column(3)))
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((len(names), FEATURES))
    for row in materialise(train.groupBy("_part").applyInArrow(count, "total binary"), "langid-counts").toLocalIterator():
        counts += np.frombuffer(row.total, np.float64).reshape(counts.shape)
    prior = counts.sum(axis=0) / max(1e-9, counts.sum())
    scale = (1 / np.sqrt(prior + 1e-4)).astype(np.float32)[:, None]
    rate = lambda side: np.log((rows := counts[side].sum(axis=0)) / max(1e-9, rows.sum()) + 2e-3 * prior + 1e-7)
    weights = np.stack([rate(c > 0) - rate(c < 0) for c in code.T], axis=1)  # where learning starts: log odds of the bit's two sides
    weights = (START * weights / scale).astype(np.float32)

    def mix(start: np.ndarray):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("_key", "ascending"), ("_lang", "ascending")]).combine_chunks()
            texts = table.column(3).combine_chunks()
            x = np.zeros(((1 + len(EXCERPTS)) * len(texts), FEATURES), np.float32)
            for i, size in enumerate((None, *EXCERPTS)):
                _features(texts, size, x[i * len(texts) : (i + 1) * len(texts)])
            x *= scale.T
            target = np.tile(code[[number[lang] for lang in table.column(1).to_pylist()]].astype(np.float32), (1 + len(EXCERPTS), 1))
            return pa.table({"n": pa.array([table.num_rows]), "weights": pa.array([learn(x, target, start).tobytes()], pa.binary())})

        return run

    for _ in range(ROUNDS):
        total, n = np.zeros(weights.shape), 0
        for row in materialise(train.groupBy("_part").applyInArrow(mix(weights), "n long, weights binary"), "langid-weights").toLocalIterator():
            total, n = total + row.n * np.frombuffer(row.weights, np.float32).reshape(weights.shape), n + row.n
        weights = (total / max(1, n)).astype(np.float32)
    model = Model(names, code, weights * scale, np.ones(code.shape[1]), np.ones(code.shape) / code.shape[1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(0))
            for low, high in arrays.chunks(offsets, CHUNK_BYTES):
                margins, letters = model.margins(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.array(letters), pa.array(list(margins.astype(np.float64)), pa.list_(pa.float64()))], names=["lang", "letters", "margins"])

    rows = held.filter("_check").select("_text", "_lang").mapInArrow(measure, "lang string, letters long, margins array<double>").filter("letters > 0").collect()
    if rows:
        margins = np.array([r.margins for r in rows])
        lang = np.array([number[r.lang] for r in rows])
        model.scale = 4 / np.maximum(1e-3, np.abs(margins).mean(axis=0))
        right = (np.sign(margins) == code[lang]).astype(np.float64)
        trust = np.ones(code.shape)
        for i in range(len(names)):
            if (lang == i).any():
                trust[i] = right[lang == i].mean(axis=0) + 1e-3
        model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns keep, by default all) with lang_pred, score and ambiguous, from the text alone.

    A text that is null or has no letter is "und" with score 0, as is every text where no language was
    learned. The new columns take the place of any of the same names. Repeated rows stay repeated.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    fields = [docs.schema[c] for c in keep]
    rows = docs.select(*keep, F.col(text_col).alias("_langid_text")) if text_col not in keep else docs.select(*keep)
    at = keep.index(text_col) if text_col in keep else len(keep)
    languages = pa.array([*model.languages, UNKNOWN], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.string_buffers(batch.column(at))
            for low, high in arrays.chunks(offsets, CHUNK_BYTES):
                margins, letters = model.margins(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                if model.languages:
                    best, score, unsure = model.decode(margins)
                else:
                    best, score, unsure = np.zeros(high - low, np.int64), np.zeros(high - low), np.zeros(high - low, bool)
                none = (letters == 0) | (not model.languages)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], languages.take(pa.array(np.where(none, len(model.languages), best))), pa.array(np.where(none, 0.0, score)), pa.array(unsure | none)],
                    names=[*keep, *MADE],
                )

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]))
