"""Nested cross-validation of Spark ML classifiers.

Folds are a relation; each task is one fit on its training rows and one scoring pass over its train,
val and test rows. Fits are submitted from a bounded thread pool, each distributed by itself. A task's predictions are
written as soon as it is done, so a run that is cut off goes on with the tasks that are missing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, fields
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.features import Categorical, FeatureSet, InputConfig, Scaler, dictionary, one_hot
from loomwork.operators.folds import NestedCV, nested_folds
from loomwork.operators.metrics import accuracy_and_mcc
from loomwork.sources.tables import exists, materialised, shared_folder


#: Settings that don't change a model here, whatever their value.
NEUTRAL = {"n_jobs", "verbose", "solver", "multi_class", "warm_start", "copy_X_train", "algorithm", "leaf_size", "classifier_name"}


@dataclass(frozen=True)
class Classifier:
    """Fields that are None don't show in the id. ``class_weight``: None, ``balanced`` (rows / (classes * rows of the class)), or pairs (class,
    weight)."""

    @property
    def id(self) -> str:
        return "_".join(f"{k}_{v}" for k, v in sorted(asdict(self).items()) if v is not None)

    @property
    def name(self) -> str:
        return type(self).__name__

    @classmethod
    def of(cls, settings: dict[str, Any], defaults: dict[str, Any] | None = None) -> Classifier:
        """The classifier of a dictionary of settings. A setting that isn't supported is an error that names it, unless it has the value in
        ``defaults`` or can't change the model."""
        known = {f.name for f in fields(cls)}
        given = {k: tuple(v.items()) if isinstance(v, dict) else v for k, v in settings.items()}
        odd = [k for k, v in given.items() if k not in known | NEUTRAL and (defaults or {}).get(k) != v]
        if odd:
            raise ValueError(f"{cls.__name__} has no {', '.join(odd)}")
        return cls(**{k: v for k, v in given.items() if k in known})

    def estimator(self, rows: int, classes: int, width: int) -> Estimator:
        raise NotImplementedError


@dataclass(frozen=True)
class Logistic(Classifier):
    """``C``: inverse strength of the penalty summed over rows, so regParam = 1 / (C * rows)."""

    C: float = 1.0
    penalty: str | None = "l2"
    l1_ratio: float | None = None
    max_iter: int = 100
    tol: float = 1e-4
    fit_intercept: bool = True
    class_weight: str | tuple | None = None

    def estimator(self, rows: int, classes: int, width: int) -> Estimator:
        mix = {"l2": 0.0, "l1": 1.0, "elasticnet": self.l1_ratio or 0.5, None: 0.0}[self.penalty]
        return LogisticRegression(regParam=1 / (self.C * max(rows, 1)) if self.penalty else 0.0, elasticNetParam=mix, maxIter=self.max_iter, tol=self.tol, fitIntercept=self.fit_intercept, standardization=False)


@dataclass(frozen=True)
class Forest(Classifier):
    """``max_samples``: share of the rows a tree is grown on. Trees are at most 30 deep, 10 without ``max_depth``."""

    n_estimators: int = 100
    max_depth: int | None = None
    criterion: str = "gini"
    min_samples_leaf: int = 1
    max_features: str = "sqrt"
    bootstrap: bool = True
    random_state: int | None = None
    min_weight_fraction_leaf: float | None = None
    min_impurity_decrease: float | None = None
    max_samples: float | None = None
    max_bins: int | None = None
    class_weight: str | tuple | None = None

    def estimator(self, rows: int, classes: int, width: int) -> Estimator:
        return RandomForestClassifier(
            numTrees=self.n_estimators, maxDepth=min(self.max_depth or 10, 30), impurity=self.criterion, minInstancesPerNode=self.min_samples_leaf, featureSubsetStrategy=str(self.max_features), bootstrap=self.bootstrap,
            seed=self.random_state or 0, minWeightFractionPerNode=self.min_weight_fraction_leaf or 0.0, minInfoGain=self.min_impurity_decrease or 0.0, subsamplingRate=self.max_samples or 1.0, maxBins=self.max_bins or 32,
        )


@dataclass(frozen=True)
class Boosting(Classifier):
    """Depth-wise boosting; more than two classes go one against the rest, without weights of classes. ``max_features``: share of the
    features a split looks at."""

    learning_rate: float = 0.1
    max_iter: int = 100
    max_depth: int | None = 5
    min_samples_leaf: int = 20
    max_bins: int = 255
    random_state: int | None = None
    max_features: float | None = None
    class_weight: str | tuple | None = None

    def estimator(self, rows: int, classes: int, width: int) -> Estimator:
        gbt = GBTClassifier(
            stepSize=self.learning_rate, maxIter=self.max_iter, maxDepth=min(self.max_depth or 10, 30), minInstancesPerNode=self.min_samples_leaf, maxBins=self.max_bins, seed=self.random_state or 0,
            featureSubsetStrategy=str(float(self.max_features)) if self.max_features else "all",
        )
        if classes > 2 and self.class_weight:
            raise ValueError("boosting of more than two classes takes no class_weight")
        return gbt if classes <= 2 else OneVsRest(classifier=gbt)


@dataclass(frozen=True)
class Perceptron(Classifier):
    hidden: int = 100
    max_iter: int = 200
    random_state: int | None = None
    tol: float = 1e-6

    def estimator(self, rows: int, classes: int, width: int) -> Estimator:
        return MultilayerPerceptronClassifier(layers=[width, self.hidden, max(classes, 2)], maxIter=self.max_iter, tol=self.tol, seed=self.random_state or 0)


def feature_vector(train: DataFrame, s: FeatureSet) -> tuple[Column, int]:
    """The assembled vector as a column expression, with scalers and dictionaries of ``train``; and its width.
    Each feature has its own scaler and width."""
    parts: list[Column] = []
    width = 0
    for f in s.numerical:
        parts.append(F.array(Scaler(f.scaler, [f.column]).fit(train).scaled(f.column) if f.scaler else F.col(f.column).cast("double")))
        width += 1
    for f in s.embeddings:
        v = F.transform(F.col(f.column), lambda x: x.cast("double"))
        if f.scaler in ("standard", "minmax", "maxabs"):
            dims = train.select(F.posexplode(f.column).alias("i", "x")).groupBy("i")
            pair = {"standard": (F.avg("x"), F.stddev_pop("x")), "minmax": (F.min("x"), F.max("x") - F.min("x")), "maxabs": (F.lit(0.0), F.max(F.abs("x")))}[f.scaler]
            rows = dims.agg(pair[0].cast("double").alias("a"), pair[1].cast("double").alias("b")).orderBy("i").collect()  # a row per dimension
            shift, scale = F.array(*(F.lit(r.a) for r in rows)), F.array(*(F.lit(r.b or 1.0) for r in rows))
            v = F.zip_with(F.zip_with(v, shift, lambda x, a: x - a), scale, lambda x, b: x / b)
        elif f.scaler == "normalizer":
            v = _unit(v)
        elif f.scaler is not None:
            raise ValueError(f"{f.scaler} isn't for vectors")
        parts.append(v)
        width += f.size
    for f in s.categorical:
        part, n = _category(train, f)
        parts.append(part)
        width += n
    return array_to_vector(F.concat(*parts)), width


def _unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(length == 0, 0.0).otherwise(x / length))


def _category(train: DataFrame, f: Categorical) -> tuple[Column, int]:
    if not f.one_hot:
        return F.array(F.col(f.column).cast("double")), 1
    values = [r["value"] for r in dictionary(train, f.column).orderBy("code").limit(10_001).collect()]
    if len(values) > 10_000:
        raise ValueError(f"{f.column} has more than 10,000 categories")
    return one_hot(F.col(f.column), values), len(values)


def fit_and_score(rows: DataFrame, s: FeatureSet, c: Classifier, target: str, key: str, features: tuple[Column, int] | None = None) -> DataFrame:
    """``rows`` has role; (key, role, target, prediction) of all roles by one fit on train. ``features``: those of ``feature_vector``, if
    they are known."""
    train = rows.where("role = 'train'")
    vector, width = features or feature_vector(train, s)
    seen = train.agg(F.count("*").alias("n"), F.max(target).alias("m")).first()
    classes = int(seen["m"] or 0) + 1
    estimator = c.estimator(seen["n"], classes, width)
    ready = train.select(vector.alias("features"), F.col(target).cast("double").alias("label"))
    weights = getattr(c, "class_weight", None)
    if weights:
        if weights == "balanced":
            count = {r["label"]: r["count"] for r in ready.groupBy("label").count().collect()}  # a row a class
            weights = [(k, seen["n"] / (len(count) * n)) for k, n in count.items()]
        of = F.lit(1.0)
        for k, w in weights:
            of = F.when(F.col("label") == float(k), float(w)).otherwise(of)
        ready, estimator = ready.withColumn("weight", of), estimator.setWeightCol("weight")
    model = Pipeline(stages=[estimator]).fit(ready)
    return model.transform(rows.select(key, "role", F.col(target).alias("target"), vector.alias("features"))).select(key, "role", "target", F.col("prediction").cast("long").alias("prediction"))


#: Rows of a block of either side, and of the test rows whose similarities are held at a time. Blocks are up to KNN_LARGE rows where
#: there are more than KNN_BLOCKS, as each row is sent to as many tasks as the other side has blocks.
KNN_BLOCK, KNN_ROWS = 8192, 256
KNN_LARGE, KNN_BLOCKS = 32_768, 8


def _blocks(rows: int) -> int:
    return max(min(-(-rows // KNN_BLOCK), max(-(-rows // max(KNN_LARGE, KNN_BLOCK)), KNN_BLOCKS)), 1)


def knn_predict(train: DataFrame, test: DataFrame, vector: str, target: str, key: str, k: int = 5, apart: str | None = None) -> DataFrame:
    """(key, prediction) by the mode of the k most similar training rows; ties go to the least key, undefined
    similarities (null or zero vectors) come last. Exact for any number of rows: blocks of both sides meet pairwise,
    each pair gives a test row's top k of it, and these are merged. With ``apart``, training rows that have the test
    row's value of this column don't count."""
    fold = (F.col(apart) if apart else F.lit(0)).alias("_f")
    n_test, n_train = (_blocks(df.count()) for df in (test, train))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64(key, vector), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    rows = test.select(F.col(key).alias("_key"), F.col(vector).alias("_v"), fold, F.xxhash64(vector).alias("_h"), block(n_test).alias("_a")).dropDuplicates(["_key", "_h", "_f"])
    side = train.select(F.col(key).alias("_i"), F.col(vector).alias("_v"), fold, F.col(target).alias("_t"), block(n_train).alias("_b"))
    kinds = {x: side.schema[x].dataType.simpleString() for x in ("_i", "_t")}
    scored = (
        rows.withColumn("_b", every(n_train))
        .groupBy("_a", "_b")
        .cogroup(side.withColumn("_a", every(n_test)).groupBy("_a", "_b"))
        .applyInArrow(lambda x, y: _nearest(x, y, k, apart is not None), f"_key {rows.schema['_key'].dataType.simpleString()}, _h long, _s double, _i {kinds['_i']}, _t {kinds['_t']}")
    )
    top = scored.groupBy("_key", "_h").agg(F.slice(F.array_sort(F.collect_list(F.struct("_s", "_i", "_t"))), 1, k).alias("n"))
    near = top.select(F.col("_key").alias(key), F.explode("n").alias("n")).groupBy(key, F.col("n._t").alias("prediction")).agg(F.count("*").alias("c"))
    best = Window.partitionBy(key).orderBy(F.desc("c"), "prediction")
    return near.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "prediction")


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, padded with zeros, and their lengths; length -1: no direction."""
    flat, n = pc.list_flatten(vectors), pc.list_value_length(vectors).to_numpy()
    if not vectors.null_count and not flat.null_count and len(n) and (n == n[0]).all():
        size, out = n.astype(int), flat.to_numpy().astype(float).reshape(len(n), -1)
    else:
        lists = [None if v is None or None in v else v for v in vectors.to_pylist()]
        size = np.array([-1 if v is None else len(v) for v in lists], int)
        out = np.zeros((len(lists), max(size.max(initial=0), 0)))
        for i, v in enumerate(lists):
            out[i, : len(v or ())] = v or ()
    with np.errstate(all="ignore"):
        norm = np.sqrt((out * out).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        return np.where(good[:, None], out / norm[:, None], 0.0), np.where(good, size, -1)


def _near(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, -similarity) of the k nearest rows of b, of unit vectors of one width. Similarities of single precision leave
    out what can't be among them; those that are left are taken in double precision."""
    n, size = len(b), max(min(128, len(b) // (4 * k)), 1)
    groups, slack = n // size, 4 * (a.shape[1] + 8) * 2.0**-24  # twice the bound of the error
    low_a, low_b = a.astype(np.float32), b.astype(np.float32).T
    at, of, by = [], [], []
    for i in range(0, len(a) if n else 0, KNN_ROWS):
        s = low_a[i : i + KNN_ROWS] @ low_b
        if groups >= k:  # k groups have a row as near as the k-th of the groups' nearest ones
            best = s[:, : groups * size].reshape(len(s), groups, size).max(axis=2)
            r, c = np.nonzero(s >= np.partition(best, groups - k, axis=1)[:, groups - k : groups - k + 1] - np.float32(slack))
        else:
            r, c = (x.ravel() for x in np.indices(s.shape))
        exact = np.concatenate([0.0 - np.round((a[i + r[j : j + 65_536]] * b[c[j : j + 65_536]]).sum(axis=1), 12) for j in range(0, len(r), 65_536)])
        order = np.lexsort((c, exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        at, of, by = [*at, r[first] + i], [*of, c[first]], [*by, exact[first]]
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, int), (of, int), (by, float)))


def _nearest(test: pa.Table, train: pa.Table, k: int, apart: bool) -> pa.Table:
    """The k nearest rows of a training block for each row of a test block."""
    train = train.take(pc.sort_indices(train, sort_keys=[("_i", "ascending"), ("_t", "ascending")], null_placement="at_start"))
    (a, la), (b, lb) = _matrix(test["_v"]), _matrix(train["_v"])
    width = min(a.shape[1], b.shape[1])  # rows of unequal length don't compare
    fa, fb = (np.array(t["_f"].to_pylist(), object) for t in (test, train))
    codes = {v: c for c, v in enumerate(dict.fromkeys([*fa, *fb]))}
    fa, fb = (np.array([codes[v] for v in f], int) for f in (fa, fb))
    at, of, by = [], [], []
    plain = len(a) and len(b) and la[0] > 0 and (la == la[0]).all() and (lb == la[0]).all()
    if plain:
        for f in np.unique(fa) if apart else (None,):
            mine, other = (np.flatnonzero(fa == f), np.flatnonzero(fb != f)) if apart else (np.arange(len(a)), np.arange(len(b)))
            r, c, s = _near(a[mine], b[other], k)
            at, of, by = [*at, mine[r]], [*of, other[c]], [*by, s]
    for i in range(0, len(a) if len(b) and not plain else 0, KNN_ROWS):
        s = 0.0 - np.round(a[i : i + KNN_ROWS, :width] @ b[:, :width].T, 12)
        s[(la[i : i + KNN_ROWS, None] != lb) | (lb < 0)] = np.inf
        if apart:
            s[fa[i : i + KNN_ROWS, None] == fb] = np.nan
        bound = np.partition(s, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1 : min(k, len(b))]  # NaN sorts last
        r, c = np.nonzero(s <= np.where(np.isnan(bound), np.inf, bound))
        order = np.lexsort((c, s[r, c], r))
        r, c = r[order], c[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        at, of, by = [*at, r[first] + i], [*of, c[first]], [*by, s[r[first], c[first]]]
    at, of, by = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, int), (of, int), (by, float)))
    return pa.table({"_key": test["_key"].take(pa.array(at)), "_h": test["_h"].take(pa.array(at)), "_s": pa.array(by), "_i": train["_i"].take(pa.array(of)), "_t": train["_t"].take(pa.array(of))})


TASK = ["feature_set_name", "classifier_name", "classifier_id", "r_outer", "k_outer", "r_inner", "k_inner"]


def train_nested_cv(df: DataFrame, inputs: InputConfig, classifiers: list[Classifier], cv: NestedCV, key: str = "cv_index", threads: int = 4, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics). Predictions: a row per task, role and key. Metrics: a row per task with accuracy and MCC of
    each role and the hyper-parameters as a map.

    Each task's predictions are a table of their own in ``folder`` (a new one in the shared folder by default). A run on the same data
    with the same ``folder`` skips the tasks that it finds there whole."""
    for s in inputs.feature_sets:
        s.check(df)
    fold = ["r_outer", "k_outer", "r_inner", "k_inner"]
    spark = df.sparkSession
    folds = materialised(nested_folds(df, cv, key), "folds")
    named = [r.asDict() for r in folds.select(*fold).distinct().orderBy(*fold).collect()]
    # each row once, with its roles: a task reads and filters it, and joins nothing
    roles = folds.groupBy(key).agg(F.collect_list(F.struct(*fold, "role")).alias("_roles"))
    placed = materialised(roles.join(df.select(*dict.fromkeys([key, inputs.target, *(x for s in inputs.feature_sets for x in s.columns)])), key), "placed")
    folder = (folder or f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}").rstrip("/")

    def run(task: tuple[FeatureSet, dict]) -> list[str]:
        """All classifiers of a fold and a feature set, whose scalers and dictionaries are made once."""
        s, r = task
        mine = F.filter("_roles", lambda x: reduce(lambda a, b: a & b, (x[k] == v for k, v in r.items())))
        rows = placed.select(*dict.fromkeys([key, inputs.target, *s.columns]), F.explode(F.transform(mine, lambda x: x["role"])).alias("role"))
        paths, features = [], None
        for c in classifiers:
            named = {"feature_set_name": s.name, "classifier_name": c.name, "classifier_id": c.id, **r}
            path = f"{folder}/{hashlib.sha256(json.dumps(named, sort_keys=True).encode()).hexdigest()[:32]}"
            paths.append(path)
            if exists(spark, f"{path}/_SUCCESS"):
                continue
            features = features or feature_vector(rows.where("role = 'train'"), s)
            out = fit_and_score(rows, s, c, inputs.target, key, features)
            hp = F.create_map(*(F.lit(str(x)) for k, v in asdict(c).items() if v is not None for x in (k, v))) if any(v is not None for v in asdict(c).values()) else F.lit(None).cast("map<string,string>")
            out.select(*(F.lit(v).alias(k) for k, v in named.items()), hp.alias("hyper_parameters"), key, "role", "target", "prediction").write.mode("overwrite").parquet(path)
        return paths

    with ThreadPoolExecutor(threads) as pool:
        paths = [p for found in pool.map(run, [(s, r) for r in named for s in inputs.feature_sets]) for p in found]
    predictions = spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths)
    scores = accuracy_and_mcc(predictions, "target", "prediction", [*TASK, "role"])
    wide = scores.groupBy(*TASK).pivot("role", ["train", "val", "test"]).agg(F.first("accuracy").alias("accuracy"), F.first("mcc").alias("mcc"))
    metrics = wide.select(*TASK, *(F.col(f"{r}_{m}").alias(f"{m}_{r}") for m in ("accuracy", "mcc") for r in ("train", "val", "test")))
    params: dict[str, Any] = {(c.name, c.id): {k: str(v) for k, v in asdict(c).items() if v is not None} for c in classifiers}
    hp = df.sparkSession.createDataFrame([(*k, v) for k, v in params.items()], "classifier_name string, classifier_id string, hyper_parameters map<string,string>")
    return predictions, metrics.join(F.broadcast(hp), ["classifier_name", "classifier_id"])  # a row per classifier
