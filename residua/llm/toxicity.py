"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbours and pairs with one word between, each hashed to 2**bits
coordinates. Training goes once or more over a bounded, documented sample of labelled rows: at most max_train_rows, taken in the
order of a hash of doc_id, and of these as many whole texts as max_train_bytes allows. Each coordinate has its own learning
rate, and the L1 term keeps most weights at nought, so the weights that are sent to the scoring tasks are few and at most
2**bits. Scoring reads every whole text.

The rates, the L1 term and the epochs (RATES) were chosen on an inner fold of the training rows: learnt where crc32(doc_id) % 3
is 0 and judged where it is 2, by log loss. The held-out fold took no part.

Defined cases: a null or empty text, or one without words, has the score of the intercept alone. Label rows with a null
doc_id or label, or without a document, teach nothing. A null doc_id is scored and is not held out. Repeated rows are
scored each. With no usable label the score is 0.5 everywhere. An empty table gives no rows. A very long text is scored whole;
if it is over max_train_bytes it isn't learnt from. drop_toxic passes other columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import guarded

THRESHOLD = 0.7
BITS = 20
RATES = {"alpha": 3.0, "beta": 1.0, "l1": 8.0, "l2": 0.0, "epochs": 5}


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, text of each feature from 0, coordinate) for slices of a column; features may repeat."""
    shift = np.uint64(64 - bits)
    for at, end, data, offsets in tk.slices(column):
        low = tk.lower(data)
        starts, ends, counts = tk.alnum_words(low, offsets)
        words = tk.SpanHash(low).of(starts, ends)
        text = np.repeat(np.arange(end - at), np.diff(counts))
        owners, marks = [text], [words]
        for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xD6E8FEB86659FD93)):
            same = np.flatnonzero(text[gap:] == text[:-gap]) if len(text) > gap else np.zeros(0, np.int64)
            owners.append(text[same])
            marks.append(tk.mix(words[same] * np.uint64(salt) + words[same + gap]))
        yield at, end, np.concatenate(owners), (np.concatenate(marks) >> shift).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate 2**bits is the intercept, which bears no L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias = 1 << bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def distinct_features(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The distinct coordinates of each text, in order."""
    for at, end, owner, mark in features(column, bits):
        both = np.unique(owner << bits | mark)
        yield from np.split((both & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64), np.searchsorted(both, np.arange(1, end - at) << bits))


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS, **rates) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not nought, from distinct features; the intercept has the coordinate 2**bits."""
    rates = RATES | rates
    epochs = rates.pop("epochs")
    model = Ftrl(bits, **rates)
    for _ in range(epochs):
        for marks, label in zip(rows, labels):
            model.learn(np.append(marks, model.bias), label)
    every = np.arange(len(model.z))
    w = model.weights(every)
    return every[w != 0], w[w != 0]


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train_rows: int = 20_000, max_train_bytes: int = 128 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the labelled rows outside the held-out fold, in one task that holds the features of the sample."""
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("label_id")))
    chosen = usable.withColumn("turn", F.xxhash64("label_id", F.lit(42))).orderBy("turn", "label_id", "toxic").limit(max_train_rows)
    # at most max_train_rows small rows are broadcast, and as many texts come to one task
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("turn", "label_id", "toxic", "text")
    order = ["turn", "label_id", "toxic", F.xxhash64("text")]
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_train_bytes).repartition(1).sortWithinPartitions(*order)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, toxic, size = [], [], 0
        for batch in batches:
            ends = size + np.cumsum([len((t.as_py() or "").encode()) for t in batch["text"]])
            batch = batch.slice(0, int((ends <= max_train_bytes).sum()))
            size = int(ends[-1]) if len(ends) else size
            marks += distinct_features(batch["text"], bits)
            toxic += batch["toxic"].to_pylist()
        at, w = fit(marks, toxic, bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["coordinate", "weight"])
        del marks
        tk.release()

    found = rows.mapInArrow(learn, "coordinate long, weight double").toArrow()
    return found["coordinate"].to_numpy(), found["weight"].to_numpy()


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, name: str = "toxicity") -> DataFrame:
    """docs with a last column of that name, from 0 to 1. The weights (at most 2**bits) go along with the task's code."""
    at, w = model
    at, w = at.astype(np.int32), w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) + 1, np.float32)
        table[at] = w
        for batch in batches:
            logit = np.full(batch.num_rows, table[-1], np.float64)
            for first, _, owner, mark in features(batch["text"], bits):
                weight = table[mark]
                some = np.flatnonzero(weight)
                pairs = np.unique(np.stack([owner[some], mark[some]]), axis=1)
                np.add.at(logit, pairs[0] + first, table[pairs[1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], names=[*batch.schema.names, name])
        tk.release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""
    docs, named = guarded(docs)
    model = train(docs, labels)
    return named(score(docs, model, name="_rsd_toxicity").where(F.col("_rsd_toxicity") < threshold).select(*docs.columns))
