"""Topic models: labels given or clustered, class TF-IDF terms, representative documents, hierarchy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import text as tx
from loomwork.functions import vectors as vx
from loomwork.operators.folds import sample_per_group
from loomwork.sources.tables import materialised

MAX_TOPICS = 2000


def cluster(df: DataFrame, vector: str, k: int, reduce_to: int | None = 5, bisecting: bool = False, seed: int = 0) -> DataFrame:
    """``df`` with ``topic``: PCA, then (bisecting) k-means. Labels from elsewhere, -1 for outliers, are as good."""
    ready = df.withColumn("_f", array_to_vector(vector))
    if reduce_to:
        ready = PCA(k=reduce_to, inputCol="_f", outputCol="_r").fit(ready).transform(ready)
    features = "_r" if reduce_to else "_f"
    model = (BisectingKMeans if bisecting else KMeans)(k=k, featuresCol=features, predictionCol="topic", seed=seed)
    return model.fit(ready).transform(ready).drop("_f", "_r")


def soft_cluster(df: DataFrame, vector: str, k: int, reduce_to: int | None = 5, least: float = 0.0, seed: int = 0, restarts: int = 4) -> DataFrame:
    """``df`` with ``topic``, ``probability`` (of that topic) and ``probabilities`` (of all): PCA, then the likeliest of ``restarts`` mixtures of
    Gaussians. A row whose probability is under ``least`` is an outlier, topic -1."""
    ready = df.withColumn("_f", array_to_vector(vector))
    if reduce_to:
        ready = PCA(k=reduce_to, inputCol="_f", outputCol="_r").fit(ready).transform(ready)
    models = [GaussianMixture(k=k, featuresCol="_r" if reduce_to else "_f", predictionCol="topic", probabilityCol="_p", seed=seed + i).fit(ready) for i in range(restarts)]
    out = max(models, key=lambda m: m.summary.logLikelihood).transform(ready).withColumn("probabilities", vector_to_array("_p")).withColumn("probability", F.array_max("probabilities"))
    return out.withColumn("topic", F.when(F.col("probability") >= least, F.col("topic")).otherwise(-1)).drop("_f", "_r", "_p")


class Strategy(Protocol):
    """Adds ``topic`` to a frame by the vectors in a column; any such function, or one of the two below."""

    def __call__(self, df: DataFrame, vector: str) -> DataFrame: ...


@dataclass(frozen=True)
class HardClusters:
    k: int
    reduce_to: int | None = 5
    bisecting: bool = False
    seed: int = 0

    def __call__(self, df: DataFrame, vector: str) -> DataFrame:
        return cluster(df, vector, self.k, self.reduce_to, self.bisecting, self.seed)


@dataclass(frozen=True)
class SoftClusters:
    k: int
    reduce_to: int | None = 5
    least: float = 0.0
    seed: int = 0

    def __call__(self, df: DataFrame, vector: str) -> DataFrame:
        return soft_cluster(df, vector, self.k, self.reduce_to, self.least, self.seed)


def topics_of_vectors(df: DataFrame, id: str, text: str, vector: str, strategy: Strategy, **settings: Any) -> tuple[TopicModel, DataFrame]:
    """The model of the topics that ``strategy`` finds, and the rows with their topics (and probabilities), written."""
    placed = materialised(strategy(df, vector), "topics")
    return fit_topics(placed, id, text, **settings), placed


@dataclass
class TopicModel:
    """``terms``: (topic, term, score, rank); ``info``: (topic, size, label, words); ``docs``: (topic, id, similarity, rank)."""

    terms: DataFrame
    info: DataFrame
    docs: DataFrame
    counts: DataFrame

    def topic(self, t: int) -> list[tuple[str, float]]:
        """The terms and scores of a topic, best first; none for a topic that isn't there."""
        return [(r.term, r.score) for r in self.terms.where(F.col("topic") == t).orderBy("rank").collect()]


Representation = Callable[[DataFrame], DataFrame]


def fit_topics(df: DataFrame, id: str, text: str, topic: str = "topic", top_n: int = 10, fraction: float = 0.6, representations: tuple[Representation, ...] = ()) -> TopicModel:
    """The model of labelled documents. ``representations`` change the relation of terms in turn."""
    for name in (id, text, topic):
        if name not in df.columns:
            raise ValueError(f"no column {name}")
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise ValueError(f"{text} is {df.schema[text].dataType.simpleString()}, not text")
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(topic).alias("topic"))
    counts = tx.term_counts(docs, "topic", "text")
    scores = tx.class_tfidf(counts, "topic")
    terms = tx.top_terms(scores, "topic", max(top_n, 30)).where(F.col("rank") <= top_n)
    for change in representations:
        terms = change(terms)
    words = tx.word_lists(terms.withColumn("rank", F.col("rank").cast("int")), "topic")
    sizes = docs.groupBy("topic").agg(F.count("*").alias("size"))
    info = sizes.join(words, "topic", "left").select("topic", "size", tx.topic_label(F.col("topic"), F.col("words")).alias("label"), "words")
    return TopicModel(terms, info, representative_documents(docs, scores, fraction), counts)


def representative_documents(docs: DataFrame, scores: DataFrame, fraction: float = 0.6, k: int = 3) -> DataFrame:
    """(topic, id, similarity, rank): the k sampled documents with the greatest cosine between their TF-IDF and the topic's.

    Sparse: joined on the term, never a dense matrix.
    """
    sample = sample_per_group(docs, "id", ("topic",), fraction=fraction)
    tf = tx.term_counts(sample, ("topic", "id"), "text")
    weight = scores.select("topic", "term", "score")
    norm = weight.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("tn"))
    pair = tf.join(weight, ["topic", "term"]).groupBy("topic", "id").agg(F.sum(F.col("n") * F.col("score")).alias("ab"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("dn"))
    sim = pair.join(norm, "topic").withColumn("similarity", F.coalesce(F.try_divide(F.col("ab"), F.col("dn") * F.col("tn")), F.lit(0.0)))
    best = Window.partitionBy("topic").orderBy(F.round("similarity", 12).desc(), "id")
    return sim.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("topic", "id", "similarity", "rank")


def topic_similarity(scores: DataFrame) -> DataFrame:
    """(a, b, similarity) of topics that share a term, by a sparse join on the term."""
    w = scores.select("topic", "term", "score")
    norm = w.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("n"))
    dots = w.select(F.col("topic").alias("a"), "term", F.col("score").alias("x")).join(w.select(F.col("topic").alias("b"), "term", F.col("score").alias("y")), "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    n = lambda c: norm.select(F.col("topic").alias(c), F.col("n").alias(f"n{c}"))
    return dots.join(n("a"), "a").join(n("b"), "b").select("a", "b", F.coalesce(F.try_divide(F.col("d"), F.col("na") * F.col("nb")), F.lit(0.0)).alias("similarity"))


def ward(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of Ward's linkage by the Lance-Williams update; new clusters are numbered from n on."""
    n = len(distance)
    check_distances(distance)
    d = distance.astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    live = list(range(n))
    for step in range(n - 1):
        sub = d[np.ix_(live, live)]
        i, j = (live[x] for x in np.unravel_index(np.argmin(sub), sub.shape))
        i, j = min(i, j), max(i, j)
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(np.sqrt(d[i, j]))))
        for k in live:
            if k not in (i, j):
                a, b, c = size[i], size[j], size[k]
                d[i, k] = d[k, i] = ((a + c) * d[i, k] + (b + c) * d[j, k] - c * d[i, j]) / (a + b + c)
        size[i] += size[j]
        ids[i] = n + step
        live.remove(j)
    return out


def check_distances(x: np.ndarray) -> None:
    if x.ndim != 2 or x.shape[0] != x.shape[1] or not np.allclose(x, x.T) or not np.allclose(np.diag(x), 0) or (x < 0).any():
        raise ValueError("a square, symmetric matrix with zeros on its diagonal and no negative number is needed")


def hierarchy(counts: DataFrame, linkage: Callable[[np.ndarray], list[tuple[int, int, float]]] = ward, names: int = 5) -> list[dict]:
    """Merges of topics from the leaves up: parent, children, their names and the distance 1 - cosine of class TF-IDF.

    The matrix has a row per topic, at most MAX_TOPICS (checked); outliers, topic -1, stay out. Names of merged topics are
    the best terms of the merged counts, one TF-IDF for all merges.
    """
    spark = counts.sparkSession
    counts = materialised(counts.where("topic != -1"), "counts")  # several steps read them
    scores = tx.class_tfidf(counts, "topic")
    topics = [r.topic for r in counts.select("topic").distinct().orderBy("topic").limit(MAX_TOPICS + 1).collect()]
    if len(topics) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    at = {t: i for i, t in enumerate(topics)}
    distance = np.ones((len(topics), len(topics)))
    np.fill_diagonal(distance, 0)
    for r in topic_similarity(scores).collect():  # at most a row per pair of topics
        distance[at[r.a], at[r.b]] = distance[at[r.b], at[r.a]] = max(0.0, 1 - r.similarity)
    members: dict[int, list] = {i: [t] for i, t in enumerate(topics)}
    merges = linkage(distance) if len(topics) > 1 else []
    for step, (a, b, _) in enumerate(merges):
        members[len(topics) + step] = members[a] + members[b]
    totals = {r.topic: r.t for r in counts.groupBy("topic").agg(F.sum("n").alias("t")).collect()}  # a row per topic
    kind = counts.schema["topic"].dataType.simpleString()
    table = spark.createDataFrame([(n, t, sum(totals[t] or 0 for t in ts)) for n, ts in members.items() for t in ts], f"node long, topic {kind}, t long")
    freq = counts.groupBy("term").agg(F.sum("n").alias("f"))
    mean = counts.groupBy("topic").agg(F.sum("n").alias("t")).agg(F.floor(F.avg("t")).alias("a"))
    # joined by term first: the terms of the nodes, many times the counts, are then summed where they are
    merged = counts.join(freq, "term").join(F.broadcast(table), "topic").groupBy("term", "node").agg(F.sum("n").alias("n"), F.first("t").alias("t"), F.first("f").alias("f"))
    scored = merged.join(F.broadcast(mean)).select("node", "term", (F.col("n") / F.col("t") * F.log(F.col("a") / F.col("f") + 1)).alias("score"))
    best = tx.word_lists(tx.top_terms(scored, "node", names), "node").select("node", "words").collect()  # a row per node
    label = {r.node: "_".join(r.words) for r in best}
    return [
        {"parent_id": len(topics) + s, "parent_name": label.get(len(topics) + s), "topics": sorted(members[len(topics) + s]), "left_id": a, "left_name": label.get(a), "right_id": b, "right_name": label.get(b), "distance": d}
        for s, (a, b, d) in enumerate(merges)
    ]


def tree(merges: list[dict], max_distance: float | None = None) -> str:
    """The hierarchy as text, the last merge first."""
    by = {m["parent_id"]: m for m in merges}
    lines: list[str] = []

    def walk(node: int, name: str, indent: str) -> None:
        m = by.get(node)
        if m is None or max_distance is not None and m["distance"] > max_distance and indent:
            lines.append(f"{indent}■──{name} ── Topic: {node}")
            return
        lines.append(f"{indent}├─{name}")
        for side in ("left", "right"):
            walk(m[f"{side}_id"], m[f"{side}_name"] or "", indent + "│    ")

    if merges:
        walk(merges[-1]["parent_id"], merges[-1]["parent_name"] or "", "")
    return "\n".join(lines)


@dataclass
class TopicMapper:
    """Versions of topic numbers: each mapping takes the numbers of the version before."""

    topics: list[int]
    history: list[dict[int, int]] = field(default_factory=list)

    def add(self, mapping: dict[int, int]) -> None:
        self.history.append(dict(mapping))

    def mapping(self, original: bool = True) -> dict[int, int]:
        """From the first numbers, or from those before the last change, to the newest."""
        if not self.history:
            return {t: t for t in self.topics}
        if not original:
            return dict(self.history[-1])
        out = {t: t for t in self.topics}
        for step in self.history:
            out = {t: step.get(v, v) for t, v in out.items()}
        return out

    def relation(self, df: DataFrame, column: str = "topic") -> DataFrame:
        from loomwork.operators.joins import map_values

        return map_values(df, column, self.mapping())


def merged_centroids(df: DataFrame, topic: str, vector: str, mapping: dict[int, int]) -> DataFrame:
    """Centroids of merged topics: means of the topics' centroids weighted by size."""
    from loomwork.operators.joins import map_values

    c = vx.centroids(df, topic, vector)
    return vx.centroids(map_values(c, topic, mapping, "merged"), "merged", "centroid", "size")
