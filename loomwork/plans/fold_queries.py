"""Queries of fold relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import folds as fd
from loomwork.sources.tables import table

MC = fd.FoldMode.MONTE_CARLO


def _folds(df: DataFrame, c: fd.KFold, key: str) -> DataFrame:
    return fd.cv_folds(df, c, key).select(key, "fold_number", "replica", "role")


def kfold_combinatorial(spark: SparkSession, d: str) -> DataFrame:
    return _folds(table(spark, d, "documents"), fd.KFold(k=5, n_test=2, seed=7), "doc_id")


def kfold_drop_remainder(spark: SparkSession, d: str) -> DataFrame:
    return _folds(table(spark, d, "documents"), fd.KFold(k=7, n_test=1, seed=7, drop_remainder=True), "doc_id")


def kfold_montecarlo(spark: SparkSession, d: str) -> DataFrame:
    return _folds(table(spark, d, "documents"), fd.KFold(k=5, n_test=1, seed=7, mode=MC, replicas=3), "doc_id")


def purged_combinatorial(spark: SparkSession, d: str) -> DataFrame:
    return _folds(table(spark, d, "events"), fd.Purged(k=5, n_test=1, seed=3, groups=("user_id",)), "event_id")


def purged_montecarlo(spark: SparkSession, d: str) -> DataFrame:
    return _folds(table(spark, d, "orders"), fd.Purged(k=5, n_test=1, seed=3, mode=MC, replicas=2, groups=("o_custkey",)), "o_orderkey")


def stratified_combinatorial(spark: SparkSession, d: str) -> DataFrame:
    return _folds(table(spark, d, "labels"), fd.Stratified(k=10, n_test=1, seed=7, groups=("quality", "toxic")), "doc_id")


def stratified_montecarlo(spark: SparkSession, d: str) -> DataFrame:
    return _folds(table(spark, d, "labels"), fd.Stratified(k=5, n_test=1, seed=7, mode=MC, replicas=3, groups=("quality", "toxic")), "doc_id")


def stratified_uniform(spark: SparkSession, d: str) -> DataFrame:
    strict = fd.Stratified(k=3, n_test=1, seed=7, groups=("quality", "toxic"), strat_mode=fd.StratMode.UNIFORM_STRICT)
    relaxed = fd.Stratified(k=3, n_test=1, seed=7, groups=("quality", "toxic"), strat_mode=fd.StratMode.UNIFORM_RELAXED, group_size=40)
    parts = [_folds(table(spark, d, "labels"), c, "doc_id").withColumn("mode", F.lit(n)) for n, c in (("strict", strict), ("relaxed", relaxed))]
    return parts[0].unionByName(parts[1])


def nested_cv_folds(spark: SparkSession, d: str) -> DataFrame:
    c = fd.NestedCV(outer=fd.Purged(k=5, seed=11, groups=("user_id",)), inner=fd.Stratified(k=4, seed=13, groups=("event_type",)))
    return fd.nested_folds(table(spark, d, "events"), c, "event_id")


def nested_cv_labels(spark: SparkSession, d: str) -> DataFrame:
    c = fd.NestedCV(outer=fd.KFold(k=2, seed=1), inner=fd.KFold(k=2, seed=2))
    folds = fd.nested_folds(table(spark, d, "labels"), c, "doc_id")
    names = [f"{o}_{i}" for o in range(2) for i in range(2)]
    return fd.fold_labels(folds, "doc_id", fd.fold_name("k_outer", "k_inner"), names).select("doc_id", *(F.col(f"`{n}`").alias(f"fold_{n}") for n in names))


def kfold_labels(spark: SparkSession, d: str) -> DataFrame:
    return fd.kfold_labels(table(spark, d, "labels"), fd.KFold(k=3, seed=5), "doc_id", ("dev", "test"))


def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumn("target", F.col("toxic") == 1)
    return fd.balanced(labels, "target", "doc_id", seed=9).select("doc_id", "target")


def resampled_kfold(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumn("target", F.col("toxic") == 1)
    return fd.resampled_folds(labels, "target", fd.KFold(k=3, seed=9), "doc_id").select("doc_id", "fold_number", "role")


def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    return fd.sample_per_group(table(spark, d, "embeddings"), "vec_id", ("label",), fraction=0.6, seed=1).select("vec_id", "label")


def row_index(spark: SparkSession, d: str) -> DataFrame:
    return fd.with_row_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "cv_index")


def train_rows_by_role(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    folds = fd.cv_folds(labels, fd.KFold(k=4, seed=2), "doc_id")
    return fd.train_test_val(labels, folds, "doc_id").groupBy("fold_number", "role").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


QUERIES = {
    f.__name__: f
    for f in (
        kfold_combinatorial, kfold_drop_remainder, kfold_montecarlo, purged_combinatorial, purged_montecarlo, stratified_combinatorial, stratified_montecarlo, stratified_uniform,
        nested_cv_folds, nested_cv_labels, kfold_labels, balanced_sample, resampled_kfold, sample_per_group, row_index, train_rows_by_role,
    )
}


def _rank(source: str, key: str, seed: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"SELECT *, row_number() OVER ({part} ORDER BY md5({seed} || ':' || {key}), {key}) AS rn, count(*) OVER ({part}) AS n FROM {source}"


def _fold(k: int, few: bool = False) -> str:
    plain = f"least((rn - 1) // greatest(n // {k}, 1), {k - 1})"
    return f"CASE WHEN n < {k} THEN {k - 1} ELSE {plain} END" if few else plain


def _splits(k: int) -> str:
    return f"(SELECT t.i::INT AS fold_number FROM range({k}) AS t(i))"


def _one_test(placed: str, key: str, k: int) -> str:
    return f"""SELECT {key}, fold_number, 0 AS replica, CASE WHEN fold = fold_number THEN 'test' ELSE 'train' END AS role FROM ({placed}), {_splits(k)}"""


def _mc(source: str, key: str, seed: int, replicas: int, k: int, by: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {key}, {i} AS fold_number, {i} AS replica, CASE WHEN rn <= n // {k} THEN 'test' ELSE 'train' END AS role FROM ({_rank(source, key, repr(str(seed + i)), by)})" for i in range(replicas))


def _purged(source: str, group: str, seed: int, k: int) -> str:
    return f"SELECT s.*, f.fold FROM {source} s JOIN (SELECT {group}, {_fold(k)} AS fold FROM ({_rank(f'(SELECT DISTINCT {group} FROM {source})', group, repr(str(seed)))})) f USING ({group})"


_LABELS = "(SELECT doc_id, toxic = 1 AS target FROM labels)"
_BALANCED = f"""(SELECT doc_id, target FROM ({_rank(_LABELS, "doc_id", "'9'", "target")}) WHERE rn <= (SELECT least(count(*) FILTER (target), count(*) FILTER (NOT target)) FROM {_LABELS}))"""
_KF = f"SELECT *, {_fold(5)} AS fold FROM ({_rank('documents', 'doc_id', repr('7'))})"
_STRICT = f"""SELECT * FROM (SELECT *, least(n, m) AS n2 FROM (SELECT r.*, (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality, toxic)) AS m FROM ({_rank("labels", "doc_id", "'7'", "quality, toxic")}) r)) WHERE rn <= m"""
_RELAXED = f"""SELECT *, least(n, 40) AS n2 FROM ({_rank("labels", "doc_id", "'7'", "quality, toxic")}) WHERE rn <= 40"""


def _uniform(source: str, mode: str) -> str:
    return _one_test(f"SELECT doc_id, {_fold(3, True)} AS fold FROM (SELECT doc_id, rn, n2 AS n FROM ({source}))", "doc_id", 3).replace("AS role FROM", f"AS role, '{mode}' AS mode FROM", 1)


_OUTER = f"""(SELECT event_id, event_type, k.i::INT AS k_outer, p.fold = k.i AS is_test FROM ({_purged("events", "user_id", 11, 5)}) p, range(5) AS k(i))"""
_DEV = f"(SELECT * FROM {_OUTER} WHERE NOT is_test)"
_INNER = f"""SELECT event_id, k_outer, {_fold(4, True)} AS fold FROM ({_rank(_DEV, "event_id", "('13/0,' || k_outer)", "k_outer, event_type")})"""
_O2 = f"(SELECT doc_id, k.i::INT AS k_outer, p.fold = k.i AS is_test FROM (SELECT doc_id, {_fold(2)} AS fold FROM ({_rank('labels', 'doc_id', repr('1'))})) p, range(2) AS k(i))"
_I2 = f"""SELECT doc_id, k_outer, {_fold(2)} AS fold FROM ({_rank(f"(SELECT * FROM {_O2} WHERE NOT is_test)", "doc_id", "('2/0,' || k_outer)", "k_outer")})"""
SQL = {
    "kfold_combinatorial": f"""WITH c AS (SELECT (row_number() OVER (ORDER BY a.i, b.i) - 1)::INT AS fold_number, a.i AS f0, b.i AS f1 FROM range(5) AS a(i), range(5) AS b(i) WHERE a.i < b.i)
        SELECT doc_id, fold_number, 0 AS replica, CASE WHEN fold IN (f0, f1) THEN 'test' ELSE 'train' END AS role FROM ({_KF}), c""",
    "kfold_drop_remainder": _one_test(f"SELECT doc_id, {_fold(7)} AS fold FROM ({_rank('documents', 'doc_id', repr('7'))}) WHERE rn <= 7 * (n // 7)", "doc_id", 7),
    "kfold_montecarlo": _mc("documents", "doc_id", 7, 3, 5),
    "purged_combinatorial": _one_test(_purged("events", "user_id", 3, 5), "event_id", 5),
    "purged_montecarlo": " UNION ALL ".join(f"SELECT o_orderkey, {i} AS fold_number, {i} AS replica, CASE WHEN fold < 4 THEN 'train' ELSE 'test' END AS role FROM ({_purged('orders', 'o_custkey', 3 + i, 5)})" for i in range(2)),
    "stratified_combinatorial": _one_test(f"SELECT doc_id, {_fold(10, True)} AS fold FROM ({_rank('labels', 'doc_id', repr('7'), 'quality, toxic')})", "doc_id", 10),
    "stratified_montecarlo": _mc("labels", "doc_id", 7, 3, 5, "quality, toxic"),
    "stratified_uniform": _uniform(_STRICT, "strict") + " UNION ALL " + _uniform(_RELAXED, "relaxed"),
    "nested_cv_folds": f"""SELECT 0 AS r_outer, k_outer, 0 AS r_inner, k.i::INT AS k_inner, event_id, CASE WHEN fold = k.i THEN 'val' ELSE 'train' END AS role FROM ({_INNER}), range(4) AS k(i)
        UNION ALL SELECT 0, k_outer, 0, k.i::INT, event_id, 'test' FROM {_OUTER}, range(4) AS k(i) WHERE is_test""",
    "nested_cv_labels": f"""WITH r AS (SELECT doc_id, k_outer, k.i AS k_inner, CASE WHEN fold = k.i THEN 'val' ELSE 'train' END AS role FROM ({_I2}), range(2) AS k(i)
        UNION ALL SELECT doc_id, k_outer, k.i, 'test' FROM {_O2}, range(2) AS k(i) WHERE is_test)
        SELECT doc_id, {", ".join(f"max(role) FILTER (k_outer = {o} AND k_inner = {i}) AS fold_{o}_{i}" for o in range(2) for i in range(2))} FROM r GROUP BY doc_id""",
    "kfold_labels": f"""SELECT doc_id, {", ".join(f"CASE WHEN fold = {i} THEN 'test' ELSE 'dev' END AS fold_{i}" for i in range(3))} FROM (SELECT doc_id, {_fold(3)} AS fold FROM ({_rank("labels", "doc_id", repr("5"))}))""",
    "balanced_sample": f"SELECT doc_id, target FROM {_BALANCED}",
    "resampled_kfold": f"""SELECT doc_id, fold_number, role FROM ({_one_test(f"SELECT doc_id, {_fold(3, True)} AS fold FROM ({_rank(_BALANCED, 'doc_id', repr('9'), 'target')})", "doc_id", 3)})""",
    "sample_per_group": f"SELECT vec_id, label FROM ({_rank('embeddings', 'vec_id', repr('1'), 'label')}) WHERE rn <= floor(n * 0.6::DOUBLE)",
    "row_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS cv_index FROM orders",
    "train_rows_by_role": f"""SELECT fold_number, role, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM ({_one_test(f"SELECT doc_id, {_fold(4)} AS fold FROM ({_rank('labels', 'doc_id', repr('2'))})", "doc_id", 4)}) JOIN labels USING (doc_id) GROUP BY ALL""",
}
