"""Vectors in array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(df: DataFrame, by: str, vector: str, weight: str | None = None) -> DataFrame:
    """(by, size, centroid): mean of each dimension, weighted by ``weight`` if given. Null vectors don't count."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(vector).isNotNull()).select(by, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    dims = rows.groupBy(by, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"), F.count("*").alias("n"))
    return dims.groupBy(by).agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).select(by, "size", F.col("p.m").alias("centroid"))


def spread_columns(df: DataFrame, vector: str, size: int) -> DataFrame:
    """The array as columns ``{vector}_{i}``, for export."""
    return df.select(*(c for c in df.columns if c != vector), *(F.get(F.col(vector), F.lit(i)).alias(f"{vector}_{i}") for i in range(size)))


def closest(df: DataFrame, by: str, id: str, vector: str, k: int = 3) -> DataFrame:
    """The ``k`` rows of each class closest to its centroid, with ``similarity`` and ``rank``."""
    scored = df.join(centroids(df, by, vector), by).select(by, id, cosine(F.col(vector), F.col("centroid")).alias("similarity"))
    order = Window.partitionBy(by).orderBy(F.round("similarity", 12).desc(), id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Centroids beyond this many numbers are refused as a literal model.
MAX_MODEL = 200_000


def nearest_centroid(df: DataFrame, centres: DataFrame, by: str, vector: str) -> DataFrame:
    """``df`` with ``predicted``, the class of the most similar centroid (ties: the least class). The model is
    one row per class, checked to be small, and goes into the plan as a constant: no join."""
    rows = centres.select(by, "centroid").orderBy(by).limit(MAX_MODEL).collect()
    if sum(len(r["centroid"]) for r in rows) > MAX_MODEL:
        raise ValueError(f"more than {MAX_MODEL} numbers of centroids")
    if not rows:
        return df.withColumn("predicted", F.lit(None).cast(centres.schema[by].dataType))
    model = F.array(*(F.struct(F.lit(r[by]).alias("c"), F.array(*map(F.lit, r["centroid"])).alias("v")) for r in rows))
    scored = F.transform(model, lambda m: F.struct(F.round(cosine(F.col(vector), m["v"]), 12).alias("s"), m["c"].alias("c")))
    best = F.array_sort(scored, lambda x, y: F.when(x["s"] > y["s"], -1).when(x["s"] < y["s"], 1).when(x["c"] < y["c"], -1).otherwise(1))
    return df.withColumn("predicted", F.get(best, F.lit(0))["c"])


def diverse(words: list[str], to_topic: np.ndarray, among: np.ndarray, diversity: float, n: int) -> list[str]:
    """Maximal marginal relevance: greedily the word with the best (1 - d) * sim(topic) - d * max sim(chosen)."""
    chosen = [int(np.argmax(to_topic))]
    while len(chosen) < min(n, len(words)):
        left = [i for i in range(len(words)) if i not in chosen]
        value = (1 - diversity) * to_topic[left] - diversity * among[np.ix_(left, chosen)].max(axis=1)
        chosen.append(left[int(np.argmax(value))])
    return [words[i] for i in chosen]


def mmr(df: DataFrame, by: str, topic: str, word: str, vector: str, diversity: float = 0.1, n: int = 10) -> DataFrame:
    """(by, rank, word) chosen by ``diverse`` among each class's candidate words; ``topic`` is the class's vector.

    A class is one group: candidates are top terms, some hundreds at most.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(word)
        v = np.array(rows[vector].tolist(), float)
        t = np.array(rows[topic].iloc[0], float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        names = diverse(rows[word].tolist(), v @ (t / max(np.linalg.norm(t), 1e-12)), v @ v.T, diversity, n)
        return pd.DataFrame({by: rows[by].iloc[0], "rank": np.arange(1, len(names) + 1), word: names})

    kind = df.schema[by].dataType.simpleString()
    return df.groupBy(by).applyInPandas(pick, f"`{by}` {kind}, rank long, `{word}` string")


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``fn`` (a pandas frame to a pandas frame) over Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield fn(f)

    return df.mapInPandas(run, schema)
