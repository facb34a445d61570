"""Queries of metrics, vectors, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import vectors as vx
from loomwork.operators import folds as fd
from loomwork.operators import joins as jn
from loomwork.operators import metrics as mt
from loomwork.sources.tables import table


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def metrics_binary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.accuracy_and_mcc(table(spark, d, "labels"), "quality", "toxic"), "accuracy", "mcc")


def metrics_by_language(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return _rounded(mt.accuracy_and_mcc(rows, "quality", "toxic", ["lang"]), "accuracy", "mcc")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vx.nearest_centroid(e, vx.centroids(e, "label", "embedding"), "label", "embedding")


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("vec_id", "label", "predicted")


def metrics_multiclass(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.accuracy_and_mcc(_nearest(spark, d), "label", "predicted"), "accuracy", "mcc")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumn("p", 1 - F.col("quality"))
    folds = fd.nested_folds(labels, fd.NestedCV(outer=fd.KFold(k=3, seed=1), inner=fd.KFold(k=3, seed=2)), "doc_id")
    by = ["r_outer", "k_outer", "r_inner", "k_inner"]
    m = mt.accuracy_and_mcc(folds.join(labels, "doc_id"), "toxic", "p", [*by, "role"])
    wide = m.groupBy(*by).pivot("role", ["train", "val", "test"]).agg(F.first("accuracy").alias("accuracy"), F.first("mcc").alias("mcc"))
    wide = wide.select(*by, *(F.col(f"{r}_{x}").alias(f"{x}_{r}") for x in ("accuracy", "mcc") for r in ("train", "val", "test")))
    return wide.select("*", F.lit("quality").alias("feature_set_name"), F.lit("rule").alias("classifier_name"), F.lit("rule_inverse").alias("classifier_id"))


def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = mt.by_inputs(_metrics(spark, d))
    return _rounded(out, *mt.METRICS, *(f"{c}_std" for c in mt.METRICS))


def metrics_by_test_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.by_inputs_and_test_fold(_metrics(spark, d)), *mt.METRICS)


def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.summary(_metrics(spark, d), by_test_fold=True), *mt.METRICS)


def value_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.quartiles(table(spark, d, "events"), ["event_type"], "value"), "low", "q1", "median", "q3", "high")


def hits_by_group(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumn("p", (1 - F.col("quality")).cast("long")).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return _rounded(mt.hits(labels, "toxic", "p", ["source"]), "acc")


def wide_predictions(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    long = labels.select("doc_id", F.lit("quality").alias("task"), F.col("quality").alias("prediction")).union(labels.select("doc_id", F.lit("toxic"), F.col("toxic")))
    return mt.wide_predictions(long, "doc_id", F.concat(F.lit("predictions_"), "task"), tasks=["predictions_quality", "predictions_toxic"])


def topic_sizes(spark: SparkSession, d: str) -> DataFrame:
    return mt.value_counts(table(spark, d, "embeddings"), "label")


def unique_ratios(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.unique_ratio(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]), "o_orderstatus", "o_orderpriority", "o_custkey")


def vector_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = vx.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "size", F.posexplode("centroid").alias("i", "m")).select("label", "size", F.col("i").cast("long").alias("i"), F.round("m", 7).alias("m"))


def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 7 + 1).withColumn("merged", F.expr("label div 2"))
    c = vx.centroids(e, "merged", "embedding", "w")
    return c.select("merged", F.posexplode("centroid").alias("i", "m")).select(F.col("merged").cast("long").alias("merged"), F.col("i").cast("long").alias("i"), F.round("m", 7).alias("m"))


def closest_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    out = vx.closest(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 3)
    return out.select("label", "vec_id", F.round("similarity", 7).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def spread_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vx.spread_columns(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 64)


def enriched_left(spark: SparkSession, d: str) -> DataFrame:
    c = jn.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), table(spark, d, "nation"), ["n_nationkey"], unique=True)
    return jn.join(c, table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], unique=True).select("c_custkey", "n_name", "r_name")


def members_and_others(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return jn.union_all(
        jn.keep_ids(c, o, "c_custkey").select("c_custkey", F.lit("has orders").alias("kind")),
        jn.join(c, o.select("c_custkey"), ["c_custkey"], "left_anti").select("c_custkey", F.lit("has none").alias("kind")),
    )


def mapped_values(spark: SparkSession, d: str) -> DataFrame:
    return jn.map_values(table(spark, d, "orders"), "o_orderstatus", {"O": "open", "F": "filled"}, "status").select("o_orderkey", "status")


def set_differences(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return a.select("l_orderkey", F.array_join(F.array_sort(F.array_except("flags", F.array(F.lit("N")))), ",").alias("rest"))


QUERIES = {
    f.__name__: f
    for f in (
        metrics_binary, metrics_by_language, nearest_centroid, metrics_multiclass, metrics_rollup, metrics_by_test_fold, metrics_summary, value_quartiles, hits_by_group, wide_predictions, topic_sizes,
        unique_ratios, vector_centroids, weighted_centroids, closest_to_centroid, spread_vectors, enriched_left, members_and_others, mapped_values, set_differences,
    )
}


def _mcc(source: str, y: str, p: str, by: str = "") -> str:
    """Sums over confusion counts."""
    pre, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    using = lambda a: f"JOIN {a} USING ({by})" if by else f", {a}"
    return f"""WITH x AS (SELECT {pre}{y} AS y, {p} AS p FROM {source}), t AS (SELECT {pre}y AS v, count(*)::DOUBLE AS t FROM x GROUP BY {pre}y), k AS (SELECT {pre}p AS v, count(*)::DOUBLE AS k FROM x GROUP BY {pre}p),
    s AS (SELECT {pre}count(*) AS n, count(*) FILTER (y = p) AS c FROM x {grp}), tt AS (SELECT {pre}sum(t * t) AS tt FROM t {grp}), kk AS (SELECT {pre}sum(k * k) AS kk FROM k {grp}),
    tk AS (SELECT {pre}sum(t * k) AS tk FROM t JOIN k USING ({pre}v) {grp})
    SELECT {pre}n, c / n AS accuracy, CASE WHEN (n::DOUBLE * n - kk) * (n::DOUBLE * n - tt) = 0 THEN 0
      ELSE (c * n::DOUBLE - coalesce(tk, 0)) / sqrt((n::DOUBLE * n - kk) * (n::DOUBLE * n - tt)) END AS mcc FROM s {using("tt")} {using("kk")} {f"LEFT JOIN tk USING ({by})" if by else ", tk"}"""


def _round_mcc(inner: str, keep: str = "") -> str:
    return f"SELECT {keep}n, round(accuracy, 9) AS accuracy, round(mcc, 9) AS mcc FROM ({inner})"


_CENTRES = """dims AS (SELECT vec_id, label, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) AS t(i)), centre AS (SELECT label, i, avg(x) AS m, count(*) AS size FROM dims GROUP BY ALL)"""
_SIM = """sums AS (SELECT vec_id, d.label, c.label AS other, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS s FROM dims d JOIN centre c USING (i) GROUP BY ALL)"""
_NEAREST = f"(WITH {_CENTRES}, {_SIM} SELECT vec_id, label, other AS predicted FROM sums QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, other) = 1)"


def _metrics_sql() -> str:
    from loomwork.plans.fold_queries import _fold, _rank

    outer = f"(SELECT doc_id, k.i::INT AS k_outer, p.fold = k.i AS is_test FROM (SELECT doc_id, {_fold(3)} AS fold FROM ({_rank('labels', 'doc_id', repr('1'))})) p, range(3) AS k(i))"
    inner = f"""(SELECT doc_id, k_outer, {_fold(3)} AS fold FROM ({_rank(f"(SELECT * FROM {outer} WHERE NOT is_test)", "doc_id", "('2/0,' || k_outer)", "k_outer")}))"""
    roles = f"""(SELECT r.*, l.toxic, 1 - l.quality AS p, k_outer || '|' || k_inner || '|' || role AS g FROM (
        SELECT doc_id, k_outer, k.i::INT AS k_inner, CASE WHEN fold = k.i THEN 'val' ELSE 'train' END AS role FROM {inner}, range(3) AS k(i)
        UNION ALL SELECT doc_id, k_outer, k.i::INT, 'test' FROM {outer}, range(3) AS k(i) WHERE is_test) r JOIN labels l USING (doc_id))"""
    cols = ", ".join(f"max({x}) FILTER (string_split(g, '|')[3] = '{r}') AS {x}_{r}" for x in ("accuracy", "mcc") for r in ("train", "val", "test"))
    return f"""SELECT 0 AS r_outer, string_split(g, '|')[1]::INT AS k_outer, 0 AS r_inner, string_split(g, '|')[2]::INT AS k_inner, {cols},
        'quality' AS feature_set_name, 'rule' AS classifier_name, 'rule_inverse' AS classifier_id FROM ({_mcc(roles, "toxic", "p", "g")}) GROUP BY ALL"""


_MEANS = ", ".join(f"round(avg({c}), 9) AS {c}" for c in mt.METRICS)
_STDS = ", ".join(f"round(stddev_samp({c}), 9) AS {c}_std" for c in mt.METRICS)
SQL = {
    "metrics_binary": _round_mcc(_mcc("labels", "quality", "toxic")),
    "metrics_by_language": _round_mcc(_mcc("(SELECT * FROM labels JOIN documents USING (doc_id))", "quality", "toxic", "lang"), "lang, "),
    "nearest_centroid": f"SELECT * FROM {_NEAREST}",
    "metrics_multiclass": _round_mcc(_mcc(_NEAREST, "label", "predicted")),
    "metrics_rollup": f"SELECT feature_set_name, classifier_id, {_MEANS}, {_STDS}, count(*) AS len FROM ({_metrics_sql()}) GROUP BY ALL",
    "metrics_by_test_fold": f"SELECT feature_set_name, classifier_id, r_outer, k_outer, {_MEANS}, count(*) AS len FROM ({_metrics_sql()}) GROUP BY ALL",
    "metrics_summary": f"SELECT classifier_name, classifier_id, feature_set_name, r_outer, r_inner, {_MEANS}, count(*) AS len FROM ({_metrics_sql()}) GROUP BY ALL",
    "value_quartiles": """SELECT event_type, round(min(value), 9) AS low, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q3, round(max(value), 9) AS high FROM events GROUP BY event_type""",
    "hits_by_group": """SELECT source, sum(CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END)::BIGINT AS hits, count(*) AS n, round(hits / n, 9) AS acc FROM labels JOIN documents USING (doc_id) GROUP BY source""",
    "wide_predictions": "SELECT doc_id, quality AS predictions_quality, toxic AS predictions_toxic FROM labels",
    "topic_sizes": "SELECT label, count(*) AS count FROM embeddings GROUP BY label",
    "unique_ratios": "SELECT " + ", ".join(f"round(count(DISTINCT {c}) / count(*), 9) AS {c}" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")) + " FROM orders",
    "vector_centroids": f"WITH {_CENTRES} SELECT label, size, i, round(m, 7) AS m FROM centre",
    "weighted_centroids": """SELECT (label // 2)::BIGINT AS merged, i, round(sum(embedding[i + 1]::DOUBLE * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1), 7) AS m FROM embeddings, range(64) AS t(i) GROUP BY ALL""",
    "closest_to_centroid": f"""WITH {_CENTRES}, {_SIM} SELECT label, vec_id, round(s, 7) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 12) DESC, vec_id) AS rank FROM sums WHERE label = other) WHERE rank <= 3""",
    "spread_vectors": "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS embedding_{i}" for i in range(64)) + " FROM embeddings",
    "enriched_left": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "members_and_others": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'has orders' ELSE 'has none' END AS kind FROM customer",
    "mapped_values": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status FROM orders",
    "set_differences": "SELECT l_orderkey, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_returnflag <> 'N'), '') AS rest FROM lineitem GROUP BY l_orderkey",
}
