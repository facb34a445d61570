"""Queries of features, scalers, classifiers, topics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.operators import features as ft
from loomwork.operators import folds as fd
from loomwork.operators import metrics as mt
from loomwork.operators import topics as tp
from loomwork.operators import train as tr
from loomwork.sources.tables import table
from loomwork.streaming import events as ev

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scaled(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS)
        out = ft.Scaler(kind, NUMBERS).fit(rows).transform(rows)
        return out.withColumns({c: F.round(c, 6) for c in NUMBERS})

    return query


def quantile_scaled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ft.Scaler("quantile", ["o_totalprice"]).fit(rows, 100).transform(rows).withColumn("o_totalprice", F.round("o_totalprice", 6))


def topic_distances(spark: SparkSession, d: str) -> DataFrame:
    """The matrix from which the hierarchy is made: 1 - cosine of each pair of topics that share a term."""
    found = tp.topic_similarity(tx.class_tfidf(_topics(spark, d).counts, "topic"))
    return found.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round(1 - F.col("similarity"), 7).alias("distance"))


def power_and_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("q"))
    out = ft.Scaler("power", ["o_totalprice"]).fit(rows).transform(rows)
    return ft.Scaler("quantile", ["q"]).fit(rows, 100).transform(out)


def category_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return ft.encode_categories(rows, ft.low_cardinality(rows, 0.05))


def one_hot_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    values = [r["value"] for r in ft.dictionary(rows, "o_orderpriority").orderBy("code").collect()]
    return rows.select("o_orderkey", F.array_join(F.transform(ft.one_hot(F.col("o_orderpriority"), values), lambda x: x.cast("int").cast("string")), "").alias("hot"))


def nested_cv_training(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("target", (F.col("label") % 2).cast("int")).withColumn("first", F.get("embedding", F.lit(0)).cast("double"))
    sets = (ft.FeatureSet(embeddings=(ft.Embedding("embedding", 64, "standard"),)), ft.FeatureSet(numerical=(ft.Numerical("first", "robust"),)))
    cv = fd.NestedCV(outer=fd.KFold(k=2, seed=1), inner=fd.Stratified(k=2, seed=2, groups=("label",)))
    _, metrics = tr.train_nested_cv(e, ft.InputConfig(sets), [tr.Logistic(max_iter=20), tr.Forest(n_estimators=5, max_depth=4, random_state=0)], cv, "vec_id")
    return mt.by_inputs(metrics)


def neighbour_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Each row as a test row of its fold, by the training rows of the same split: those of all other folds."""
    e = table(spark, d, "embeddings")
    tests = fd.cv_folds(e, fd.KFold(k=5, seed=4), "vec_id").where("role = 'test'").select("vec_id", "fold_number").join(e, "vec_id")
    return tr.knn_predict(tests, tests, "embedding", "label", "vec_id", 5, apart="fold_number")


def clustered_topics(spark: SparkSession, d: str) -> DataFrame:
    return mt.value_counts(tp.cluster(table(spark, d, "embeddings"), "embedding", 8), "topic")


def _topics(spark: SparkSession, d: str) -> tp.TopicModel:
    docs = table(spark, d, "documents").withColumn("topic", F.regexp_extract("source", r"(\d+)$", 1).cast("int"))
    return tp.fit_topics(docs, "doc_id", "text", top_n=5)


def topic_info(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d).info.select(F.col("topic").cast("long").alias("topic"), "size", "label", F.array_join("words", " ").alias("words"))


def topic_documents(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d).docs.select(F.col("topic").cast("long").alias("topic"), "id", F.round("similarity", 7).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def topic_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    rows = tp.hierarchy(_topics(spark, d).counts)
    kinds = "parent_id long, parent_name string, topics string, left_id long, right_id long, distance double"
    return spark.createDataFrame([(m["parent_id"], m["parent_name"], ",".join(map(str, m["topics"])), m["left_id"], m["right_id"], m["distance"]) for m in rows], kinds)


def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of the whole stream; complete mode, as no later event closes the last window."""
    events = table(spark, d, "events")
    stream = ev.read_stream(spark, f"{d}/events*.parquet", events.schema)
    rows = ev.tumbling(stream, length="1 day").withColumn("total", F.round("total", 4))
    name = "windows_" + str(abs(hash(d)))
    query = rows.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def streamed_prompts(spark: SparkSession, d: str) -> DataFrame:
    stream = ev.read_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    return ev.run_available(ev.prompts(stream.select("event_id", "event_type", "user_id"), "{} by {}", [F.col("event_type"), F.col("user_id")]).select("event_id", "prompt"), "prompts")


QUERIES = {f"scaled_{k}": _scaled(k) for k in ("standard", "minmax", "maxabs", "robust", "normalizer")} | {
    f.__name__: f
    for f in (
        power_and_quantile, quantile_scaled, topic_distances, category_codes, one_hot_priority, nested_cv_training, neighbour_predictions, clustered_topics, topic_info, topic_documents, topic_hierarchy, streamed_windows, streamed_prompts,
    )
}


def _scale_sql(shift: str, scale: str) -> str:
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - {shift.format(c=c)}) / {scale.format(c=c)}, 6) AS {c}" for c in NUMBERS) + " FROM lineitem"


from loomwork.plans.fold_queries import _fold, _rank  # noqa: E402
from loomwork.plans.text_queries import _IDF, _counts, _tfidf  # noqa: E402

_TOPIC_DOCS = "(SELECT *, regexp_extract(source, '([0-9]+)$', 1)::INT AS topic FROM documents)"
_WORDS = f"{_counts('topic', _TOPIC_DOCS)}, {_tfidf('topic', _IDF)}"
SQL = {
    "scaled_standard": _scale_sql("(avg({c}) OVER ())", "(stddev_pop({c}) OVER ())"),
    "scaled_minmax": _scale_sql("(min({c}) OVER ())", "((max({c}) OVER ()) - (min({c}) OVER ()))"),
    "scaled_maxabs": _scale_sql("0", "(max(abs({c})) OVER ())"),
    "scaled_robust": _scale_sql("(SELECT quantile_cont({c}, 0.5) FROM lineitem)", "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"),
    "scaled_normalizer": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c} / sqrt(l_quantity ** 2 + l_extendedprice ** 2 + l_discount ** 2), 6) AS {c}" for c in NUMBERS) + " FROM lineitem",
    "category_codes": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders",
    "quantile_scaled": """WITH m AS (SELECT quantile_cont(o_totalprice, [i / 100 for i in range(101)]) AS q FROM orders), b AS (SELECT o_orderkey, o_totalprice AS x, q, len(list_filter(q, lambda y: y <= x)) AS n FROM orders, m)
        SELECT o_orderkey, round(CASE WHEN n = 0 THEN 0 WHEN n >= 101 THEN 1 ELSE (n - 1 + coalesce((x - q[n]) / nullif(q[n + 1] - q[n], 0), 0)) / 100 END, 6) AS o_totalprice FROM b""",
    "topic_distances": f"""WITH {_WORDS}, nn AS (SELECT topic, sqrt(sum(score * score)) AS n FROM scores GROUP BY topic),
        p AS (SELECT x.topic AS a, y.topic AS b, sum(x.score * y.score) AS d FROM scores x JOIN scores y ON x.term = y.term AND x.topic < y.topic GROUP BY ALL)
        SELECT a::BIGINT AS a, b::BIGINT AS b, round(1 - d / (na.n * nb.n), 7) AS distance FROM p JOIN nn na ON na.topic = a JOIN nn nb ON nb.topic = b""",
    "neighbour_predictions": f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_fold(5)} AS fold FROM ({_rank("embeddings", "vec_id", repr("4"))})),
        s AS (SELECT x.vec_id, y.label, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.v, y.v), 12) DESC, y.vec_id) AS r FROM e x JOIN e y ON x.fold <> y.fold),
        c AS (SELECT vec_id, label, count(*) AS c FROM s WHERE r <= 5 GROUP BY ALL)
        SELECT vec_id, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1""",
    "one_hot_priority": "SELECT o_orderkey, string_agg(CASE WHEN v = o_orderpriority THEN '1' ELSE '0' END, '' ORDER BY v) AS hot FROM orders, (SELECT DISTINCT o_orderpriority AS v FROM orders) GROUP BY o_orderkey",
    "topic_info": f"""WITH {_WORDS}, w AS (SELECT topic, string_agg(term, ' ' ORDER BY rank) AS words, string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS l FROM ranks WHERE rank <= 5 GROUP BY topic)
        SELECT s.topic::BIGINT AS topic, size, s.topic || '_' || l AS label, words FROM (SELECT topic, count(*) AS size FROM {_TOPIC_DOCS} GROUP BY topic) s LEFT JOIN w ON w.topic = s.topic""",
    "topic_documents": f"""WITH {_WORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('1:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY topic) AS m FROM {_TOPIC_DOCS}),
        one AS ({_counts("doc_id, topic", "(SELECT * FROM r WHERE rn <= floor(m * 0.6::DOUBLE))").replace("cleaned AS (", "WITH c2 AS (", 1).replace("FROM cleaned", "FROM c2").replace("counts AS (", "k2 AS (", 1)} SELECT * FROM k2),
        nn AS (SELECT topic, sqrt(sum(score * score)) AS tn FROM scores GROUP BY topic),
        p AS (SELECT o.topic, doc_id, sum(n * score) / (sqrt(sum(n * n)) * any_value(tn)) AS s FROM one o JOIN scores USING (topic, term) JOIN nn USING (topic) GROUP BY ALL)
        SELECT topic::BIGINT AS topic, doc_id AS id, round(s, 7) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(s, 12) DESC, doc_id) AS rank FROM p) WHERE rank <= 3""",
    "streamed_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "streamed_prompts": "SELECT event_id, event_type || ' by ' || user_id AS prompt FROM events",
}
