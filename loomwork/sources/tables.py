"""Readers and writers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One table of all paths, such as the shards of a dataset's split."""
    return spark.read.parquet(*paths)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def from_rows(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_jsonl(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.text(path)


def write_result_lines(responses: DataFrame, path: str, metadata: str | None = None, mode: str = "append") -> None:
    """Responses of a service as JSON lines, [request, response or errors] and perhaps metadata (a column of JSON text), as the readers of
    result lines take them. Appends files to the folder."""
    outcome = F.coalesce("response", F.to_json("errors"))
    line = F.concat(F.lit("["), "request", F.lit(", "), outcome, *([F.coalesce(F.concat(F.lit(", "), metadata), F.lit(""))] if metadata else []), F.lit("]"))
    responses.select(line.alias("value")).write.mode(mode).text(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder of a local session that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="loomwork-"))
    return "file://" + _LOCAL[0].name


_WRITTEN: list[str] = []


def _delete_written() -> None:
    from pyarrow import fs

    for path in _WRITTEN:
        try:
            where, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
            where.delete_dir(name)
        except (OSError, ValueError):  # gone already, or on a file system that only Spark reaches
            pass


def delete_at_exit(path: str) -> None:
    if not _WRITTEN:
        atexit.register(_delete_written)
    _WRITTEN.append(path)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; deleted when this Python process ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_feature_sets(df: DataFrame, sets: dict[str, list[str]], folder: str, key: str = "cv_index", target: str = "target") -> None:
    """One table per feature set: key, target and its columns."""
    for name, columns in sets.items():
        df.select(*dict.fromkeys([key, target, *columns])).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_feature_set(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def check_feature_sets(spark: SparkSession, folder: str, names: list[str]) -> None:
    missing = [n for n in names if not exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(f"no table for {', '.join(missing)} in {folder}")


def save_results(predictions: DataFrame, metrics: DataFrame, folder: str, run: str) -> None:
    """Both relations, partitioned by run."""
    for name, df in (("predictions", predictions), ("metrics", metrics)):
        df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{folder}/{name}")


_MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines are arrays: request, response or errors, perhaps metadata."""
    return spark.read.text(path).select(F.from_json("value", "array<string>").alias("x")).select(F.get("x", F.lit(0)).alias("request"), F.get("x", F.lit(1)).alias("response"), F.get("x", F.lit(2)).alias("metadata"))


def read_chat_results(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """(messages, choice, usage, results, errors, metadata); a failed request has nulls and its errors."""
    mode = {"mode": "FAILFAST"} if typed else {}
    ok = F.col("response").startswith("{")
    body = F.from_json(
        F.when(ok, F.col("response")),
        f"struct<id:string,model:string,choices:array<struct<index:int,message:{_MESSAGE},finish_reason:string>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>",
        mode,
    )
    request = F.from_json("request", "struct<model:string,messages:array<struct<role:string,content:string>>>")
    return _lines(spark, path).withColumn("b", body).select(
        request["messages"].alias("messages"),
        F.get(F.col("b.choices"), F.lit(0))["message"].alias("choice"),
        F.col("b.usage").alias("usage"),
        F.when(ok, F.col("response")).alias("results"),
        F.when(~ok, F.from_json("response", "array<string>")).alias("errors"),
        "metadata",
    )


def read_embedding_results(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(model, input, embedding, errors), a row per input of single and of batched requests. The embedding column is
    ``{column}_{model}_embedding`` if all lines have one model, else ``{column}_embedding``; empty where missing."""
    request = F.from_json("request", "struct<model:string,input:string>")
    many = F.from_json(F.get_json_object("request", "$.input"), "array<string>")
    inputs = F.when(F.get_json_object("request", "$.input").startswith("["), many).otherwise(F.array(request["input"]))
    ok = F.col("response").startswith("{")
    data = F.from_json(F.when(ok, F.col("response")), "struct<data:array<struct<object:string,embedding:array<double>>>>")["data"]["embedding"]
    rows = _lines(spark, path).select(F.get_json_object("request", "$.model").alias("model"), inputs.alias("i"), data.alias("d"), F.when(~ok, F.from_json("response", "array<string>")).alias("errors"))
    flat = rows.select("model", "errors", F.posexplode("i").alias("k", "input"), "d")
    out = flat.select("model", "input", F.coalesce(F.get("d", F.col("k")), F.array().cast("array<double>")).alias("embedding"), "errors")
    models = [r.model for r in out.select("model").distinct().limit(2).collect()]
    return out.withColumnRenamed("embedding", f"{column}_{models[0]}_embedding" if len(models) == 1 else f"{column}_embedding")
