"""Queries of row operations, readers and sinks, and of results by model and split."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.operators import features as ft
from loomwork.operators import folds as fd
from loomwork.operators import joins as jn
from loomwork.operators import metrics as mt
from loomwork.operators import service as sv
from loomwork.operators import topics as tp
from loomwork.plans.fold_queries import _fold, _one_test, _purged, _rank
from loomwork.plans.service_queries import FAST
from loomwork.sources import tables as tb
from loomwork.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query's own files, deleted when the process ends."""
    path = f"{tb.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    tb.delete_at_exit(path)
    return path


def divided_labels(spark: SparkSession, d: str) -> DataFrame:
    yes, no = fd.divide_by_target(table(spark, d, "labels").withColumn("target", F.col("toxic") == 1), "target")
    return jn.union_all(yes.select("doc_id", F.lit("toxic").alias("part")), no.select("doc_id", F.lit("clean").alias("part")))


def narrowed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Columns left out, rows without a value left out, a threshold."""
    o = table(spark, d, "orders").drop("o_orderpriority", "o_orderstatus")
    return o.where(F.col("o_totalprice").isNotNull() & (F.col("o_totalprice") > 250_000)).select("o_orderkey", "o_custkey")


def drawn_per_source(spark: SparkSession, d: str) -> DataFrame:
    return fd.sample_per_group(table(spark, d, "documents"), "doc_id", ("source",), n=7, seed=3).select("doc_id", "source")


def dearest_orders(spark: SparkSession, d: str) -> DataFrame:
    """The ten dearest: the first rows of a sorted table."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def joined_lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    both = F.concat(F.slice("embedding", 1, 3), F.slice("embedding", 62, 3))
    return e.select("vec_id", F.array_join(F.transform(both, lambda x: F.round(x.cast("double"), 6).cast("decimal(12,6)").cast("string")), " ").alias("numbers"))


def turns_by_conversation(spark: SparkSession, d: str) -> DataFrame:
    """Groups as lists."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda t: t["role"]), ">").alias("roles"))


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """A left join and a filter for null."""
    c = jn.join(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), ["c_custkey"])
    return c.where("o_orderkey is null").select("c_custkey")


def lines_with_parts(spark: SparkSession, d: str) -> DataFrame:
    """A join on several keys that multiplies no row."""
    first = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("most"))
    return jn.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), first, ["l_partkey", "l_suppkey"], unique=True).select("l_orderkey", "l_linenumber", "most")


def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """The orders by key beside the orders by date, row by row."""
    by_date = table(spark, d, "orders").select("o_orderdate", F.col("o_orderkey").alias("dated"))
    return jn.side_by_side(table(spark, d, "orders").select("o_orderkey"), by_date, ["o_orderkey"], ["o_orderdate", "dated"]).select("o_orderkey", "dated")


def gathered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows at given places of a sorted table."""
    places = table(spark, d, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("place"))
    return jn.gathered(table(spark, d, "customer").select("c_custkey"), places, "place", ["c_custkey"])


def named_features(spark: SparkSession, d: str) -> DataFrame:
    sets = [ft.FeatureSet((ft.Numerical("b"), ft.Numerical("a")), (), (ft.Categorical("c"),)), ft.FeatureSet((ft.Numerical("z"),))]
    return table(spark, d, "region").select("r_regionkey", *(F.lit(s.name).alias(f"name{i}") for i, s in enumerate(sets)))


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "tsv")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    n.write.option("sep", "\t").option("header", True).csv(path)
    return tb.read_tsv(spark, path, "n_nationkey int, n_name string")


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "jsonl")
    tb.write_jsonl(table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("line")), "line", path)
    return tb.read_jsonl(spark, path, "event_id long, event_type string")


def feature_set_tables(spark: SparkSession, d: str) -> DataFrame:
    """Feature sets as tables: written, checked, read."""
    folder = _folder(spark, "features")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cv_index"), (F.col("o_orderstatus") == "F").cast("int").alias("target"), "o_totalprice", "o_custkey")
    tb.save_feature_sets(o, {"price": ["o_totalprice"], "customer": ["o_custkey"]}, folder)
    tb.check_feature_sets(spark, folder, ["price", "customer"])
    parts = [tb.load_feature_set(spark, folder, n).select(F.lit(n).alias("name"), "cv_index", "target") for n in ("price", "customer")]
    return jn.union_all(*parts).groupBy("name").agg(F.count("*").alias("n"), F.sum("target").alias("targets"))


def result_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two runs appended to one folder."""
    folder = _folder(spark, "results")
    p = table(spark, d, "labels").select("doc_id", F.col("quality").alias("prediction"))
    m = mt.accuracy_and_mcc(table(spark, d, "labels"), "toxic", "quality")
    for run in ("a", "b"):
        tb.save_results(p, m, folder, run)
    return spark.read.parquet(f"{folder}/predictions").groupBy("run").agg(F.count("*").alias("n"), F.sum("prediction").alias("positive"))


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    """Responses appended as JSON lines and read with types; a failed call among them."""
    folder = _folder(spark, "lines")

    def answer(request: dict) -> dict:
        x = request["messages"][1]["content"]
        if x.startswith("A"):
            raise ValueError("an A")
        return {"choices": [{"index": 0, "message": {"role": "assistant", "content": x.lower()}}], "usage": {"prompt_tokens": len(x), "completion_tokens": 1, "total_tokens": len(x) + 1}}

    requests = table(spark, d, "nation").select(sv.chat_request(sv.chat_messages("s", F.col("n_name")), "m").alias("request"))
    tb.write_result_lines(sv.call_service(requests, sv.FunctionClient(answer), FAST), folder)
    r = tb.read_chat_results(spark, folder, typed=True)
    return r.select(F.get("messages", F.lit(1))["content"].alias("asked"), F.col("choice.content").alias("answer"), F.col("usage.total_tokens").alias("tokens"), F.size("errors").cast("long").alias("failures"))


def answered_events(spark: SparkSession, d: str) -> DataFrame:
    """Chat answers beside the rows that asked."""

    def answer(request: dict) -> dict:
        x = request["messages"][1]["content"]
        return {"choices": [{"message": {"role": "assistant", "content": x.upper()}}], "usage": {"prompt_tokens": len(x), "completion_tokens": 2, "total_tokens": len(x) + 2}}

    out = sv.chat_column(table(spark, d, "events").select("event_id", "event_type"), "event_type", "s", "m", sv.FunctionClient(answer), FAST)
    return out.select("event_id", F.col("event_type_m_answer").alias("answer"), F.col("event_type_m_usage.total_tokens").alias("tokens"))


def embedded_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two columns by two models."""
    client = sv.FunctionClient(lambda r: {"data": [{"embedding": [float(len(r["input"])), float(len(r["model"]))]}]})
    models = ["text-embedding-3-small", "text-embedding-ada-002"]
    out = sv.embed_columns(table(spark, d, "nation").select("n_name", F.lower("n_name").alias("small")), ["n_name", "small"], models, client, FAST)
    total = reduce(lambda a, b: a + b, (F.get(F.col(f"{c}_{m}_embedding"), F.lit(i)) for c in ("n_name", "small") for m in models for i in (0, 1)))
    return out.select("n_name", total.alias("total"))


def call_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a run in which calls fail for good, and by a rate limit and an answered error."""

    def answer(request: dict) -> dict:
        n = request["n"]
        if n % 5 == 0:
            raise sv.RateLimited("slow down")
        if n % 5 == 1:
            raise sv.ApiError("no")
        if n % 5 == 2:
            raise ValueError("odd")
        return {"ok": n}

    requests = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("n"))).alias("request"))
    return sv.status_counts(sv.call_service(requests, sv.FunctionClient(answer), sv.RunnerConfig(1e9, 1e12, max_attempts=2, cool_down_s=0.0, partitions=2)))


def named_message_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Chat tokens of messages with names, and embedding tokens of several texts at once."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    message = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), F.when(t["role"] == "user", "Ann Lee").alias("name"))
    return c.select(
        "conv_id",
        sv.message_tokens(F.transform("x", message), named=True).alias("chat"),
        sv.request_tokens("embeddings", F.transform("x", lambda t: t["text"]), many=True).alias("embedding"),
    )


def purged_labels(spark: SparkSession, d: str) -> DataFrame:
    return fd.kfold_labels(table(spark, d, "events"), fd.Purged(k=3, seed=5, groups=("user_id",)), "event_id")


def stratified_labels(spark: SparkSession, d: str) -> DataFrame:
    return fd.kfold_labels(table(spark, d, "labels"), fd.Stratified(k=3, seed=5, groups=("toxic",)), "doc_id")


def sorted_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds without shuffling."""
    return fd.cv_folds(table(spark, d, "orders"), fd.KFold(k=4, shuffle=False), "o_orderkey").select("o_orderkey", "fold_number", "role")


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The view by split, as sums of the keys on either side."""
    folds = fd.cv_folds(table(spark, d, "labels"), fd.KFold(k=4, seed=2), "doc_id")
    total = lambda df: df.agg(F.sum("doc_id").alias("s"))
    parts = [total(a).crossJoin(total(b).withColumnRenamed("s", "t")).select(F.lit(n).alias("fold_number"), F.col("s").alias("train"), F.col("t").alias("test")) for n, _, a, b in fd.split_ids(folds, "doc_id")]  # one row each
    return jn.union_all(*parts)


def precomputed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Fold columns that are there already, and nested labels beside all columns."""
    labels = table(spark, d, "labels")
    joined = fd.nested_labels(labels, fd.NestedCV(outer=fd.KFold(k=2, seed=1), inner=fd.KFold(k=2, seed=2)), "doc_id", return_joined=True)
    return fd.nested_labels(joined.drop("quality", "toxic"), None, "doc_id")


def model_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The predictions of one input and model, of two folds, from a long relation of several."""
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("target"), F.col("quality").alias("prediction"))
    tasks = spark.createDataFrame([(s, "Rule", c, 0, k, 0, 0, "test") for s in ("f", "g") for c in ("c1", "c2") for k in range(3)], "feature_set_name string, classifier_name string, classifier_id string, r_outer int, k_outer int, r_inner int, k_inner int, role string")
    long = labels.crossJoin(F.broadcast(tasks)).where(F.col("doc_id") % 3 == F.col("k_outer"))  # twelve rows
    return mt.predictions_of(long, "g", "Rule", "c2", [(0, 0, 0, 0), (0, 2, 0, 0)]).select("doc_id", "k_outer", "prediction")


def mapped_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic numbers through two mappings."""
    mapper = tp.TopicMapper(list(range(20)))
    mapper.add({t: t // 2 for t in range(20)})
    mapper.add({t: t % 5 for t in range(10)})
    return mapper.relation(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("topic")).where("topic < 20"), "topic").select("vec_id", "topic")


def changed_terms(spark: SparkSession, d: str) -> DataFrame:
    """Topic terms through a representation that leaves long words alone."""
    docs = table(spark, d, "documents").withColumn("topic", F.regexp_extract("source", r"(\d+)$", 1).cast("int"))
    model = tp.fit_topics(docs, "doc_id", "text", top_n=5, representations=(lambda t: t.where(F.length("term") <= 6),))
    return model.terms.select(F.col("topic").cast("long").alias("topic"), "term")


def class_texts(spark: SparkSession, d: str) -> DataFrame:
    """Terms and their counts by language, as a text each."""
    counts = tx.term_counts(table(spark, d, "benchmark").withColumn("one", F.lit(1)), "one", "text")
    return counts.where("n >= 5").groupBy("one").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "term", F.col("n").cast("string")))), " ").alias("terms"))  # a benchmark's vocabulary


QUERIES = {
    f.__name__: f
    for f in (
        divided_labels, narrowed_orders, drawn_per_source, dearest_orders, joined_lists, turns_by_conversation, customers_without_orders, lines_with_parts, side_by_side, gathered_rows, named_features,
        tsv_round_trip, jsonl_round_trip, feature_set_tables, result_tables, result_lines, answered_events, embedded_columns, call_counters, named_message_tokens, purged_labels, stratified_labels, sorted_folds,
        split_sizes, precomputed_labels, model_predictions, mapped_topics, changed_terms, class_texts,
    )
}

_N = r"len(regexp_extract_all({}, '[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]'))"
_THREE = ", ".join(f"CASE WHEN fold = {i} THEN 'test' ELSE 'train' END AS fold_{i}" for i in range(3))


def _sql() -> dict[str, str]:
    from loomwork.plans.fold_queries import _I2, _O2
    from loomwork.plans.model_queries import _TOPIC_DOCS, _WORDS
    from loomwork.plans.text_queries import _counts

    names = ", ".join(f"max(role) FILTER (k_outer = {o} AND k_inner = {i}) AS fold_0_{o}_0_{i}" for o in range(2) for i in range(2))
    return {
        "divided_labels": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS part FROM labels WHERE toxic IS NOT NULL",
        "narrowed_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000",
        "drawn_per_source": f"SELECT doc_id, source FROM ({_rank('documents', 'doc_id', repr('3'), 'source')}) WHERE rn <= 7",
        "dearest_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
        "joined_lists": "SELECT vec_id, array_to_string(list_transform(embedding[1:3] || embedding[62:64], lambda x: round(x::DOUBLE, 6)::DECIMAL(12, 6)::VARCHAR), ' ') AS numbers FROM embeddings",
        "turns_by_conversation": "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id",
        "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
        "lines_with_parts": "SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey) AS most FROM lineitem",
        "side_by_side": """SELECT o_orderkey, dated FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) JOIN (SELECT o_orderkey AS dated, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders) USING (i)""",
        "gathered_rows": "SELECT place, c_custkey FROM (SELECT n_nationkey * 3 AS place FROM nation) LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) USING (place)",
        "named_features": "SELECT r_regionkey, 'a_b_c' AS name0, 'z' AS name1 FROM region",
        "tsv_round_trip": "SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation",
        "jsonl_round_trip": "SELECT event_id, event_type FROM events",
        "feature_set_tables": "SELECT name, count(*) AS n, sum(t)::BIGINT AS targets FROM (SELECT unnest(['price', 'customer']) AS name, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS t FROM orders) GROUP BY name",
        "result_tables": "SELECT run, count(*) AS n, sum(quality)::BIGINT AS positive FROM labels, (SELECT unnest(['a', 'b']) AS run) GROUP BY run",
        "result_lines": """SELECT n_name AS asked, CASE WHEN n_name NOT LIKE 'A%' THEN lower(n_name) END AS answer, CASE WHEN n_name NOT LIKE 'A%' THEN length(n_name) + 1 END AS tokens, CASE WHEN n_name LIKE 'A%' THEN 5::BIGINT END AS failures FROM nation""",
        "answered_events": "SELECT event_id, upper(event_type) AS answer, length(event_type) + 2 AS tokens FROM events",
        "embedded_columns": f"SELECT n_name, (4 * length(n_name) + {2 * (len('text-embedding-3-small') + len('text-embedding-ada-002'))})::DOUBLE AS total FROM nation",
        "call_counters": """SELECT count(*) AS started, 0::BIGINT AS in_progress, count(*) FILTER (n_nationkey % 5 > 2) AS succeeded, count(*) FILTER (n_nationkey % 5 <= 2) AS failed, 2 * count(*) FILTER (n_nationkey % 5 = 0) AS rate_limit_errors,
            2 * count(*) FILTER (n_nationkey % 5 = 1) AS api_errors, 2 * count(*) FILTER (n_nationkey % 5 = 2) AS other_errors FROM nation""",
        "named_message_tokens": f"""SELECT conv_id, (17 + sum(4 + {_N.format("role")} + {_N.format("text")} + CASE WHEN role = 'user' THEN 1 ELSE 0 END))::BIGINT AS chat, sum({_N.format("text")})::BIGINT AS embedding FROM conversations GROUP BY conv_id""",
        "purged_labels": f"SELECT event_id, {_THREE} FROM ({_purged('events', 'user_id', 5, 3)})",
        "stratified_labels": f"SELECT doc_id, {_THREE} FROM (SELECT doc_id, {_fold(3, True)} AS fold FROM ({_rank('labels', 'doc_id', repr('5'), 'toxic')}))",
        "sorted_folds": f"""SELECT o_orderkey, fold_number, role FROM ({_one_test(f"SELECT o_orderkey, {_fold(4)} AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)", "o_orderkey", 4)})""",
        "split_sizes": f"""SELECT fold_number, (sum(doc_id) FILTER (role = 'train'))::BIGINT AS train, (sum(doc_id) FILTER (role = 'test'))::BIGINT AS test FROM ({_one_test(f"SELECT doc_id, {_fold(4)} AS fold FROM ({_rank('labels', 'doc_id', repr('2'))})", "doc_id", 4)}) GROUP BY fold_number""",
        "precomputed_labels": f"""WITH r AS (SELECT doc_id, k_outer, k.i AS k_inner, CASE WHEN fold = k.i THEN 'val' ELSE 'train' END AS role FROM ({_I2}), range(2) AS k(i)
            UNION ALL SELECT doc_id, k_outer, k.i, 'test' FROM {_O2}, range(2) AS k(i) WHERE is_test) SELECT doc_id, {names} FROM r GROUP BY doc_id""",
        "model_predictions": "SELECT doc_id, (doc_id % 3)::INT AS k_outer, quality AS prediction FROM labels WHERE doc_id % 3 IN (0, 2)",
        "mapped_topics": "SELECT vec_id, label // 2 % 5 AS topic FROM embeddings WHERE label < 20",
        "changed_terms": f"WITH {_WORDS} SELECT topic::BIGINT AS topic, term FROM ranks WHERE rank <= 5 AND length(term) <= 6",
        "class_texts": f"WITH {_counts('one', '(SELECT 1 AS one, * FROM benchmark)')} SELECT one, string_agg(x, ' ' ORDER BY x) AS terms FROM (SELECT one, term || ':' || n AS x FROM counts WHERE n >= 5) GROUP BY one",
    }


SQL = _sql()
