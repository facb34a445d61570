"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Map tasks turn the training texts into sorted feature indices and write them; one task then reads
them once an epoch, in order, and runs the sequential FTRL updates over the bounded sample. It streams:
its memory is the two arrays of ``2**bits`` numbers and an Arrow batch, however long the texts are. L1 leaves
few weights, so what is broadcast is at most ``2**bits`` floats. Scoring is one Arrow pass, without a shuffle.

Nulls and empty texts have no features and score the bias. A null label is no label; of
repeated label rows of an id the larger counts; of repeated documents with one id in the
training sample one counts (the least text). Every input row is scored, repeated ones too.
Without any training row all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm._columns import others
from loomwork.llm._store import drop, lean, small_batches, written
from loomwork.llm._words import ALNUM, Words, chunks, mix

_U = np.uint64
STEM = 5


@dataclass(frozen=True)
class ToxicityConfig:
    """``max_train_rows`` bounds the labelled sample that is fitted (hash order); all rows are scored."""

    bits: int = 22
    max_train_rows: int = 20_000
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    threshold: float = 0.7


def _features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, index) of each occurrence: words, their stems, pairs of neighbours, pairs with one word between.

    A stem is the word's first STEM bytes; it lets unseen endings count.
    """
    (h, stem), doc = words.hashes(STEM), words.doc
    pair, skip = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    two = h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:]
    gap = h[:-2] * _U(0xC2B2AE3D27D4EB4F) + h[2:] + _U(1)
    index = np.concatenate([h, mix(stem + _U(2)), mix(two[pair]), mix(gap[skip])]) >> _U(64 - bits)
    return np.concatenate([doc, doc, doc[1:][pair], doc[2:][skip]]), index.astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in chunks(batch, "text"):
            doc, index = _features(Words(data, off, ALNUM), bits)
            key = np.unique(doc << bits | index)
            cut = np.searchsorted(key >> bits, np.arange(b - a + 1))
            flat = (key & (1 << bits) - 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))
            part = batch.slice(a, b - a)
            yield pa.record_batch([part.column("order"), part.column("label"), lists], ["order", "label", "features"])


def _fit(batches: Iterator[pa.RecordBatch], c: ToxicityConfig) -> Iterator[pa.RecordBatch]:
    """Updates by the rows in the order in which they come."""
    d = 1 << c.bits
    z, n = np.zeros(d + 1), np.zeros(d + 1)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        w = (np.sign(z) * l1 - z) / ((c.beta + np.sqrt(n)) / c.alpha + c.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    seen = False
    for batch in batches:
        lists = batch.column("features")
        flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, y in enumerate(batch.column("label").to_pylist()):
            seen, x = True, flat[off[i] : off[i + 1]]
            zi, ni = z[x], n[x]
            w = weights(zi, ni, c.l1)
            wb = float(weights(z[d:], n[d:], 0.0)[0])
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - y
            root = np.sqrt(ni + g * g)
            z[x] = zi + g - (root - np.sqrt(ni)) / c.alpha * w
            n[x] = ni + g * g
            z[d] += g - (np.sqrt(n[d] + g * g) - np.sqrt(n[d])) / c.alpha * wb
            n[d] += g * g
    w = weights(z, n, c.l1)
    w[d] = weights(z[d:], n[d:], 0.0)[0]
    at = np.flatnonzero(w)
    if seen:
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(w[at])], ["index", "weight"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> np.ndarray:
    """Weights, the last of them the bias. ``docs``: doc_id, text; ``labels``: doc_id, toxic.

    Labels beyond ``max_train_rows`` aren't used; the sample is the first rows in hash order of the id.
    """
    c = config
    small_batches(docs.sparkSession)
    sample = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(c.max_train_rows)
    )
    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id")  # at most max_train_rows rows of three numbers
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("order").alias("order"), F.first("label").alias("label"))
        .select("order", F.col("label").cast("double").alias("label"), "text")
    )
    sets = texts.mapInArrow(lean(lambda it: _sets(it, c.bits)), "order long, label double, features array<int>")
    sets, path = written(sets, "features")
    runs = sets.select(F.explode(F.sequence(F.lit(1), F.lit(c.epochs))).alias("epoch"), "order", "label", "features").coalesce(1).sortWithinPartitions("epoch", "order", "label")  # one task reads the bounded table, without a shuffle
    found = runs.mapInArrow(lean(lambda it: _fit(it, c)), "index long, weight double").toPandas()  # at most 2**bits rows
    drop(docs.sparkSession, path)
    w = np.zeros((1 << c.bits) + 1, np.float32)
    w[found["index"].to_numpy()] = found["weight"].to_numpy()
    if not len(found):
        w[-1] = -1e4
    return w


def score_toxicity(df: DataFrame, weights: np.ndarray, config: ToxicityConfig = ToxicityConfig(), text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``predicted`` added (columns of those names are replaced)."""
    kept = others(df.columns, "score", "predicted")
    schema = df.select(*kept).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    of, threshold = _scorer(df, weights, config, text), config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = of(batch)
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], schema.names)

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(lean(run), schema)


def reject_toxic(df: DataFrame, weights: np.ndarray, config: ToxicityConfig = ToxicityConfig(), text: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is under the threshold, with all their columns as they are."""
    of, threshold = _scorer(df, weights, config, text), config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(of(batch) < threshold))

    return df.mapInArrow(lean(run), df.schema)


def _scorer(df: DataFrame, weights: np.ndarray, config: ToxicityConfig, text: str):
    """The scores of an Arrow batch, as a function for the executors."""
    bits = config.bits
    at = np.flatnonzero(weights[:-1]).astype(np.int32)
    sent = df.sparkSession.sparkContext.broadcast((at, weights[at], float(weights[-1])))
    dense: list = []
    small_batches(df.sparkSession)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        at, value, bias = sent.value
        if not dense:
            w = np.zeros(1 << bits, np.float32)
            w[at] = value
            dense.append(w)
        scores = np.zeros(batch.num_rows)
        for a, b, data, off in chunks(batch, text):
            doc, index = _features(Words(data, off, ALNUM), bits)
            w = dense[0][index]
            key = np.unique((doc << bits | index)[w != 0])
            total = np.bincount(key >> bits, dense[0][key & (1 << bits) - 1].astype(np.float64), b - a)
            scores[a:b] = 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
        if bias <= -1e4:
            scores[:] = 0
        return scores

    return of
