"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbouring words, and pairs with one word between, A-Z in lower case, hashed to 2**BITS places. FTRL-proximal
keeps a learning rate for each place and sets most weights to exactly 0 (L1), so the model is a short list of places and weights. It is
fitted in one task on at most TRAIN_ROWS labelled rows (lowest hashes of doc_id), of which that task holds the features; a lost executor means that it runs again. The driver sees the weights alone (at most 2**BITS, some thousand in practice), which closures carry to the workers. Scoring is a map over whole texts: no shuffle.

Nulls and empty texts are learned from and score as a text without words (the bias alone); rows with a null label or doc_id are not learned from. Several labels of one document:
the highest counts. Rows repeated in full are learned from each time. No usable label: every score is 0. Other columns stay as they are; score() raises if its column's name is taken. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._text import BYTE_CODE, LOWER, U64, buffers, forget, give_back, lean, mix, prefix, slices, span_hash, words

BITS = 20
TRAIN_ROWS = 20_000
EPOCHS = 5
LEAST_TEXTS = 5  # a feature of fewer learned texts has no weight
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
THRESHOLD = 0.3


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places), with repeats, of all features."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[buf]
    starts, ends, rows = words(low, offsets)
    h = span_hash(*prefix(BYTE_CODE[low]), starts, ends)
    kinds, owners = [h], [rows]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        near = rows[gap:] == rows[:-gap] if len(rows) > gap else np.zeros(0, bool)
        kinds.append(mix(h[:-gap][near] * U64(salt) + h[gap:][near] if len(near) else h[:0]))
        owners.append(rows[:-gap][near] if len(near) else rows[:0])
    return np.concatenate(owners), (np.concatenate(kinds) & U64((1 << BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Non-zero weights, by place in ascending order."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    fitted: bool = True

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.fitted:
            return np.zeros(n)
        dense = np.zeros(1 << BITS, np.float64)
        dense[self.places] = self.weights
        out = np.full(n, self.bias)
        for a, b in slices(offsets):
            at = offsets[a : b + 1]
            rows, places = features(buf[at[0] : at[-1]], at - at[0])
            some = dense[places] != 0
            own = np.unique(rows[some] << BITS | places[some])  # each feature once in a text
            out[a:b] += np.bincount(own >> BITS, weights=dense[own & ((1 << BITS) - 1)], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], *, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over the rows of all parts (bytes, offsets, toxic), epoch after epoch in a seeded order. Of a part its features alone are held."""
    own: list[np.ndarray] = []
    marks = [np.zeros(0)]
    texts = np.zeros(1 << BITS, np.int64)
    for buf, offsets, marked in parts:
        marks.append(marked)
        for a, b in slices(offsets):
            at = offsets[a : b + 1]
            rows, places = features(buf[at[0] : at[-1]], at - at[0])
            key = np.unique(rows << BITS | places)
            found = (key & ((1 << BITS) - 1)).astype(np.int32)
            texts += np.bincount(found, minlength=1 << BITS)
            own += np.split(found, np.searchsorted(key >> BITS, np.arange(1, b - a)))
    toxic = np.concatenate(marks)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, False)
    common = texts >= LEAST_TEXTS
    for k, places in enumerate(own):
        own[k] = places[common[places]]
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias, without L1

    def weights(at: np.ndarray) -> np.ndarray:
        far = np.abs(z[at]) - np.where(at == size, 0.0, L1)
        return np.where(far > 0, -np.sign(z[at]) * far / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(6)
    for _ in range(epochs):
        for i in rng.permutation(len(own)).tolist():
            at = np.append(own[i], size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - toxic[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = np.flatnonzero(z[:size])
    w = weights(every)
    kept = w != 0
    return Model(every[kept], w[kept].astype(np.float32), float(weights(np.array([size]))[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Model:
    """A model of labels.toxic, from the labelled rows that are not held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows are broadcast
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    learned = sample.orderBy(*order).limit(rows).coalesce(1).sortWithinPartitions(*order).select(F.col("text"), F.col("toxic").cast("double").alias("toxic"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit((*buffers(batch.column(0)), batch.column(1).to_numpy()) for batch in batches)
        if model.fitted:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(model.places, -1)), pa.array(np.append(model.weights.astype(np.float64), model.bias))], names=["place", "weight"])

    table = learned.mapInArrow(lean(fitted), "place long, weight double").toArrow()  # place -1: the bias
    places, weights = table.column(0).to_numpy(), table.column(1).to_numpy()
    if not len(places):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, False)
    return Model(places[places >= 0], weights[places >= 0].astype(np.float32), float(weights[places < 0][0]))


def score(df: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """df with the model's score of text_col, from 0 to 1, as a column of a new name."""
    if name.lower() in map(str.lower, df.columns):
        raise ValueError(f"there is a column {name!r} already: choose another name")

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for column in columns:
            yield pa.array(model.scores(*buffers(column)), pa.float64())
        give_back()

    return df.withColumn(name, scores(F.col(text_col)))


def op6(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Documents that score below THRESHOLD, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score(rows, model).filter(F.col("score") < THRESHOLD).select("row.*")
