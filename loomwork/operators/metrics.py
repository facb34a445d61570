"""Scores of predictions and their roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.quantiles import quantiles

METRICS = ["accuracy_train", "accuracy_val", "accuracy_test", "mcc_train", "mcc_val", "mcc_test"]


def accuracy_and_mcc(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, accuracy, mcc) from confusion counts. MCC is the multiclass R_K, 0 where its denominator is 0."""
    by = by or []
    cells = df.groupBy(*by, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    t = cells.groupBy(*by, "_y").agg(F.sum("_c").alias("_t"))
    k = cells.groupBy(*by, "_p").agg(F.sum("_c").alias("_k"))
    both = t.join(k.withColumnRenamed("_p", "_y"), [*by, "_y"])
    key = [*by] or ["_one"]
    one = (lambda d: d) if by else (lambda d: d.withColumn("_one", F.lit(1)))
    total = one(cells).groupBy(*key).agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_c")).otherwise(0)).alias("c"))
    tt = one(t).groupBy(*key).agg(F.sum(F.col("_t").cast("double") * F.col("_t")).alias("tt"))
    kk = one(k).groupBy(*key).agg(F.sum(F.col("_k").cast("double") * F.col("_k")).alias("kk"))
    tk = one(both).groupBy(*key).agg(F.sum(F.col("_t").cast("double") * F.col("_k")).alias("tk"))
    m = total.join(tt, key).join(kk, key).join(tk, key, "left")
    s = F.col("n").cast("double")
    mcc = F.try_divide(F.col("c") * s - F.coalesce("tk", F.lit(0.0)), F.sqrt((s * s - F.col("kk")) * (s * s - F.col("tt"))))
    return m.select(*by, "n", (F.col("c") / F.col("n")).alias("accuracy"), F.coalesce(mcc, F.lit(0.0)).alias("mcc"))


def roll_up(metrics: DataFrame, by: list[str], columns: list[str] = METRICS, std: bool = True) -> DataFrame:
    """Mean (and sample standard deviation, ``_std``) of the metric columns by ``by``, and ``len``."""
    aggs = [F.avg(c).alias(c) for c in columns]
    if std:
        aggs += [F.stddev_samp(c).alias(f"{c}_std") for c in columns]
    return metrics.groupBy(*by).agg(*aggs, F.count("*").alias("len"))


def by_inputs(metrics: DataFrame) -> DataFrame:
    return roll_up(metrics, ["feature_set_name", "classifier_id"])


def by_inputs_and_test_fold(metrics: DataFrame) -> DataFrame:
    return roll_up(metrics, ["feature_set_name", "classifier_id", "r_outer", "k_outer"], std=False)


def summary(metrics: DataFrame, by_test_fold: bool = False) -> DataFrame:
    """By classifier, hyper-parameters and features (and outer and inner replica), best validation MCC first."""
    by = ["classifier_name", "classifier_id", "feature_set_name", *(["r_outer", "r_inner"] if by_test_fold else [])]
    return roll_up(metrics, by, std=False).orderBy(F.desc("mcc_val"))


def quartiles(metrics: DataFrame, by: list[str], column: str = "mcc_val") -> DataFrame:
    """The numbers of a box plot, exact for any number of rows."""
    return quantiles(metrics, by, column, [0.0, 0.25, 0.5, 0.75, 1.0]).select(*by, *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))))


def wide_predictions(predictions: DataFrame, key: str, task: Column, value: str = "prediction", tasks: list[str] | None = None) -> DataFrame:
    """One column per task: a single pivot of the long relation."""
    return predictions.withColumn("_task", task).groupBy(key).pivot("_task", tasks).agg(F.first(value))


def predictions_of(predictions: DataFrame, feature_set: str, classifier: str, classifier_id: str, folds: list[tuple[int, int, int, int]] | None = None) -> DataFrame:
    """The predictions of one input and one model, of all folds or of ``folds`` (r_outer, k_outer, r_inner, k_inner); ValueError names
    what isn't there."""
    rows = predictions.where((F.col("feature_set_name") == feature_set) & (F.col("classifier_name") == classifier) & (F.col("classifier_id") == classifier_id))
    fold = ["r_outer", "k_outer", "r_inner", "k_inner"]
    there = {tuple(r) for r in rows.select(*fold).distinct().collect()}  # a row a fold
    if not there:
        raise ValueError(f"no predictions of {classifier} {classifier_id} on {feature_set}")
    if folds is None:
        return rows
    missing = [f for f in folds if tuple(f) not in there]
    if missing:
        raise ValueError(f"no predictions of {classifier} {classifier_id} on {feature_set} in the folds {missing}")
    wanted = predictions.sparkSession.createDataFrame([tuple(f) for f in folds], ", ".join(f"{c} int" for c in fold))
    return rows.join(F.broadcast(wanted), fold, "left_semi")  # a row a fold


def predictions_by_model(predictions: DataFrame) -> Iterator[tuple[str, str, str, DataFrame]]:
    """(feature set, classifier, its id, predictions of all folds) of every input and model."""
    names = ["feature_set_name", "classifier_name", "classifier_id"]
    for r in predictions.select(*names).distinct().orderBy(*names).collect():  # a row a model
        yield *r, predictions_of(predictions, *r)


def hits(predictions: DataFrame, target: str, prediction: str, by: list[str]) -> DataFrame:
    """(by, hits, n, acc): predictions that agree with a 0/1 target."""
    agreed = F.sum(F.when(F.col(target) == 1, F.col(prediction)).otherwise(1 - F.col(prediction)))
    return predictions.groupBy(*by).agg(agreed.alias("hits"), F.count("*").alias("n")).withColumn("acc", F.col("hits") / F.col("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def unique_ratio(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per row of each column, in one aggregate."""
    f = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*((f(c) / F.count("*")).alias(c) for c in columns))
