"""Quality classification by naive Bayes support vectors.

A text's features are indicators of n-grams: its byte trigrams, its letter-shape trigrams (each byte as one of eight
classes: lower, upper, digit, space, line feed, sentence mark, other mark, non-ASCII), and runs in which words repeat
those k places before, k from 1 to 8, by the length of the run. Each indicator is scaled by its class log-count ratio;
over the scaled indicators dual coordinate descent fits a linear hinge-loss (support vector) model. The score is a
logistic function of the margin.

Learning takes a bounded sample: the `sample` labelled documents of each class whose ids have the least hashes. Their
indicators are laid into one task as bitmaps of 8 KB, which fits the model there; the driver gets its weights only.
Scoring takes whole texts.

Defined results: empty, blank and null texts have no indicators and score by the model's bias; without labels of both
classes every score is the smoothed share of label 1 among them (0.5 without labels); several labels of one id count as their
greatest; of several texts of one id one is learned from; bytes that aren't UTF-8 are read as U+FFFD; repeated rows give
repeated results; a null id is never learned from, keeps a null `held_out`, and is filtered by its text like others; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from agendum.llm.common import by_bytes, id_crc, text_of, unit_hash, utf8
from agendum.llm.wordhash import word_hashes

#: log2 of the places for byte trigrams; shape trigrams and repeats follow.
BITS = 16
SHAPES = 8**3
LAGS, RUNS = 8, 8
FEATURES = (1 << BITS) + SHAPES + LAGS * RUNS
PIECE = 1 << 20


def _shape_table() -> np.ndarray:
    out = np.full(256, 6, np.uint32)
    out[128:] = 7
    for kind, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), b".,;:?!'\"-()")):
        out[list(chars)] = kind
    out[ord("!")] = 6
    return out


_SHAPE = _shape_table()


def presence(text: bytes | None) -> np.ndarray:
    """Of every feature, whether a text has it."""
    seen = np.zeros(FEATURES, bool)
    data = np.frombuffer(text or b"", np.uint8)
    for i in range(0, max(0, len(data) - 2), PIECE):
        part = data[i : i + PIECE + 2].astype(np.uint32)
        three = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        seen[three * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)] = True
        shape = _SHAPE[part]
        seen[(1 << BITS) + (shape[:-2] * 8 + shape[1:-1]) * 8 + shape[2:]] = True
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    for lag in range(1, LAGS + 1):
        if len(words) > lag:
            edges = np.flatnonzero(np.diff(words[lag:] == words[:-lag], prepend=False, append=False))
            runs = edges[1::2] - edges[::2]
            runs = runs[runs >= lag]  # the whole group of words comes again
            if len(runs):
                steps = np.minimum(np.log2(runs // lag).astype(int), RUNS - 1)
                seen[(1 << BITS) + SHAPES + (lag - 1) * RUNS + steps] = True
    return seen


def indicators(text: bytes | None) -> np.ndarray:
    """The sorted numbers of the features that a text has."""
    return np.flatnonzero(presence(text))


@dataclass
class Model:
    """A bias and a weight a feature, with its ratio folded in; a text's indicators are scaled to unit length."""

    bias: float
    weights: np.ndarray
    slope: float = 2.0

    def score(self, text: bytes | None) -> float:
        found = indicators(text)
        margin = self.bias + float(self.weights[found].sum()) / np.sqrt(max(1, len(found)))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin, -500, 500))))


@dataclass(frozen=True)
class Fit:
    """Bounds and parameters of learning."""

    sample: int = 1500
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 20
    seed: int = 5


def fit(features: list[np.ndarray], labels: list[int], params: Fit = Fit()) -> Model:
    """Scale indicators by class log-count ratios, then solve the L1-loss support vector dual one coordinate at a time."""
    y = np.array(labels, float) * 2 - 1
    if abs(y.sum()) == len(y):  # one class, or nothing
        share = (np.sum(y > 0) + params.smoothing) / (len(y) + 2 * params.smoothing)
        return Model(float(np.log(share / (1 - share))), np.zeros(FEATURES), 1.0)
    counts = {s: params.smoothing + np.bincount(np.concatenate([f for f, t in zip(features, y, strict=True) if t == s]), minlength=FEATURES) for s in (1, -1)}
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    x = [ratio[f] / np.sqrt(max(1, len(f))) for f in features]
    square = np.array([v @ v + 1 for v in x])
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    top = {s: params.cost * len(y) / (2 * np.sum(y == s)) for s in (1, -1)}  # classes weigh alike
    rng = np.random.default_rng(params.seed)
    for _ in range(params.epochs):
        for i in rng.permutation(len(y)):
            f, v = features[i], x[i]
            gradient = y[i] * (weights[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[y[i]])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[f] += step * v
                bias += step
                alpha[i] = new
    return Model(bias, weights * ratio)


def learn(docs: DataFrame, labels: DataFrame, params: Fit = Fit()) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality of 0 or 1)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, 1.5 * params.sample / sizes.get(1, 1)).otherwise(1.5 * params.sample / sizes.get(0, 1))
    order = Window.partitionBy("quality").orderBy("h", "doc_id")
    near = known.withColumn("h", unit_hash(F.col("doc_id"), F.lit("quality"))).where(F.col("h") < share)
    taken = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= params.sample).select("doc_id", "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows = texts.join(F.broadcast(taken), "doc_id").select("doc_id", "quality", "text")  # at most 2 * sample ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits(presence(x)).tobytes() for x in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["doc_id", "quality", "found"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        features = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), count=FEATURES)).astype(np.int32) for _, _, x in got]
        model = fit(features, [y for _, y, _ in got], params)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.slope]), pa.array([model.weights.tobytes()], pa.binary())], ["bias", "slope", "weights"])

    one_each = rows.mapInArrow(read, "doc_id long, quality int, found binary").groupBy("doc_id", "quality").agg(F.min("found").alias("found"))
    got = one_each.repartition(1).mapInArrow(fitted, "bias double, slope double, weights binary").first()
    return fit([], [], params) if got is None else Model(got["bias"], np.frombuffer(got["weights"]), got["slope"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in by_bytes(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([shared.value.score(x) for x in texts[i:j]], pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, params: Fit = Fit(), folds: int = 3) -> DataFrame:
    """scored() with a model learned from labels whose id's crc32 modulo folds isn't 1; held_out marks the others."""
    held = id_crc(F.col("doc_id")) % folds == 1
    return scored(docs, learn(docs, labels.where(~held), params)).select("doc_id", held.alias("held_out"), "score", "predicted")


def good(docs: DataFrame, labels: DataFrame, params: Fit = Fit(), folds: int = 3) -> DataFrame:
    """The documents that are predicted to be of good quality; the others go. Each row is judged by its own text, where
    it is."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.where(id_crc(F.col("doc_id")) % folds != 1), params))

    @F.arrow_udf("boolean")
    def fine(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x) >= 0.5 for x in utf8(texts)], pa.bool_())

    return docs.where(fine(text_of("text")))
