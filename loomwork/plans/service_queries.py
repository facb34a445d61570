"""Queries of service payloads, token counts and responses; the client is a deterministic stand-in."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import chat_marks
from loomwork.operators import service as sv
from loomwork.sources.tables import read_chat_results, read_embedding_results, shared_folder, table, write_jsonl

MODEL = "text-embedding-3-small"
SCHEMA = {"title": "Props", "type": "object", "properties": {"k": {"type": "integer", "maximum": 50}, "tag": {"anyOf": [{"type": "string"}, {"type": "null"}]}}, "required": ["k"]}
FAST = sv.RunnerConfig(max_requests_per_minute=1e9, max_tokens_per_minute=1e12, cool_down_s=0.0, partitions=8)


def _embed(request: dict) -> dict:
    x = request["input"]
    if len(x) % 10 == 0:
        raise ValueError("length divisible by 10")
    return {"data": [{"object": "embedding", "embedding": [float(len(x)), float(x.count("e"))]}], "model": request["model"]}


def _generate(request: dict) -> dict:
    n = len(request["inputs"])
    return {"generated_text": json.dumps({"k": n % 100}) if n % 4 else "no json"}


def embedding_payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(sv.embedding_request(F.col("text"), MODEL)).alias("digest"))


def batched_payloads(spark: SparkSession, d: str) -> DataFrame:
    return sv.batched_embedding_requests(table(spark, d, "events"), "event_id", "event_type", MODEL, 100).select("batch", F.md5("request").alias("digest"))


def chat_payloads(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(sv.chat_request(sv.chat_messages("Be brief.", F.col("text")), "small")).alias("digest"))


def chat_payloads_with_schema(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events")
    return c.select("event_id", sv.chat_request(sv.chat_messages("Label it.", F.col("event_type")), "small", SCHEMA).alias("request"))


def generation_payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", sv.generation_request(F.lit("Label it."), F.col("event_type"), SCHEMA).alias("request"))


def token_costs(spark: SparkSession, d: str) -> DataFrame:
    out = sv.embedding_cost(table(spark, d, "documents"), "text", MODEL)
    return out.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.round(F.sum("price"), 12).alias("price"))


def chat_token_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", sv.message_tokens(sv.chat_messages("Be brief.", F.col("text")), n=2).alias("chat"), sv.request_tokens("completions", F.col("text")).alias("completion"), sv.request_tokens("embeddings", F.col("text")).alias("embedding"))


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    out = sv.embed_column(table(spark, d, "documents").select("doc_id", "text"), "text", MODEL, sv.FunctionClient(_embed), FAST, check_cap=False)
    v = F.col(f"text_{MODEL}_embedding")
    return out.select("doc_id", F.get(v, F.lit(0)).alias("length"), F.get(v, F.lit(1)).alias("es"), F.size(f"text_{MODEL}_errors").cast("long").alias("failures"))


def generated_events(spark: SparkSession, d: str) -> DataFrame:
    out = sv.generate_column(table(spark, d, "events").select("event_id", "event_type"), "event_type", "Label it.", sv.FunctionClient(_generate), FAST, SCHEMA)
    return out.select("event_id", "event_type_Props", "event_type_Props_validations", "event_type_Props_errors")


def validated_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("Props", F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", r"\}", "")).otherwise(F.col("props")))
    return sv.validate_columns(e.select("event_id", "Props"), SCHEMA).select("event_id", "Props_validations", "Props_errors")


def read_embedding_lines(spark: SparkSession, d: str) -> DataFrame:
    """Writes result lines of batched requests, a failed one among them, and reads them."""
    n = table(spark, d, "nation")
    line = F.when(
        F.col("n_nationkey") % 5 == 0, F.concat(F.lit("["), F.to_json(F.struct(F.lit("m").alias("model"), F.array("n_name", F.lit("x")).alias("input"))), F.lit(', ["failed"]]'))
    ).otherwise(
        F.concat(F.lit("["), F.to_json(F.struct(F.lit("m").alias("model"), F.array("n_name", F.lit("x")).alias("input"))), F.lit(', {"data": [{"object": "embedding", "embedding": ['), F.col("n_nationkey").cast("string"), F.lit('.5]}, {"object": "embedding", "embedding": [1.0]}]}]'))
    )
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    write_jsonl(n.select(line.alias("line")), "line", path)
    out = read_embedding_results(spark, path, "text")
    return out.groupBy("input").agg(F.count("*").alias("n"), F.sum(F.size("text_m_embedding")).alias("numbers"), F.round(F.sum(F.coalesce(F.get("text_m_embedding", F.lit(0)), F.lit(0.0))), 3).alias("total"), F.count("errors").alias("failed"))


def read_chat_lines(spark: SparkSession, d: str) -> DataFrame:
    """Writes chat result lines and reads them."""
    n = table(spark, d, "nation")
    request = F.to_json(F.struct(F.lit("m").alias("model"), sv.chat_messages("s", F.col("n_name")).alias("messages")))
    answer = F.concat(F.lit('{"choices": [{"index": 0, "message": {"role": "assistant", "content": "'), F.lower("n_name"), F.lit('"}}], "usage": {"prompt_tokens": '), F.length("n_name").cast("string"), F.lit(', "completion_tokens": 1, "total_tokens": 2}}'))
    line = F.concat(F.lit("["), request, F.lit(", "), F.when(F.col("n_regionkey") == 0, '["timeout"]').otherwise(answer), F.lit("]"))
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    write_jsonl(n.select(line.alias("line")), "line", path)
    r = read_chat_results(spark, path)
    return r.select(F.get("messages", F.lit(1))["content"].alias("asked"), F.col("choice.content").alias("answer"), F.col("usage.prompt_tokens").alias("prompt_tokens"), F.get("errors", F.lit(0)).alias("error"))


QUERIES = {
    f.__name__: f
    for f in (
        embedding_payloads, batched_payloads, chat_payloads, chat_payloads_with_schema, generation_payloads, token_costs, chat_token_counts, embedded_documents, generated_events, validated_props,
        read_embedding_lines, read_chat_lines,
    )
}

_N = r"len(regexp_extract_all({}, '[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]'))"
_TOOLS = json.dumps(sv.function_call(SCHEMA))[1:]
_PARAMS = json.dumps({"max_new_tokens": 1024, "stop": ["<|eot_id|>"], "grammar": {"type": "json", "value": SCHEMA}})
_MARKS = chat_marks()
_HEAD = "'" + json.dumps(_MARKS[0] + "Label it." + _MARKS[1])[1:-1] + "' || event_type || '" + json.dumps(_MARKS[2])[1:-1] + "'"
_LEN = f"({sum(map(len, _MARKS)) + 9} + length(event_type))"
_MSG = "[{'role': 'system', 'content': 'SYS'}, {'role': 'user', 'content': COL}]"
SQL = {
    "embedding_payloads": f"SELECT conv_id, turn, md5(to_json({{'model': '{MODEL}', 'input': text}})::VARCHAR) AS digest FROM conversations",
    "batched_payloads": f"""SELECT batch, md5(to_json({{'model': '{MODEL}', 'input': list(event_type ORDER BY event_id)}})::VARCHAR) AS digest FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch FROM events) GROUP BY batch""",
    "chat_payloads": f"SELECT conv_id, turn, md5(to_json({{'model': 'small', 'messages': {_MSG.replace('SYS', 'Be brief.').replace('COL', 'text')}}})::VARCHAR) AS digest FROM conversations",
    "chat_payloads_with_schema": f"""SELECT event_id, rtrim(to_json({{'model': 'small', 'messages': {_MSG.replace("SYS", "Label it.").replace("COL", "event_type")}}})::VARCHAR, '}}') || '}}]' || ', {_TOOLS}' AS request FROM events""".replace("'}') || '}]'", "']}') || '}]'"),
    "generation_payloads": f"""SELECT event_id, '{{"inputs":"' || {_HEAD} || '", "parameters": {_PARAMS}}}' AS request FROM events""",
    "token_costs": f"SELECT source, sum(n)::BIGINT AS tokens, max(n)::BIGINT AS longest, round(sum(n * 2e-8), 12) AS price FROM (SELECT source, {_N.format('text')} AS n FROM documents) GROUP BY source",
    "chat_token_counts": f"""SELECT conv_id, turn, (8 + 2 + 30 + 1 + 3 + 1 + {_N.format("text")})::BIGINT AS chat, ({_N.format("text")} + 15)::BIGINT AS completion, {_N.format("text")}::BIGINT AS embedding FROM conversations""",
    "embedded_documents": """SELECT doc_id, CASE WHEN length(text) % 10 <> 0 THEN length(text)::DOUBLE END AS length, CASE WHEN length(text) % 10 <> 0 THEN (length(text) - length(replace(text, 'e', '')))::DOUBLE END AS es,
        CASE WHEN length(text) % 10 = 0 THEN 5::BIGINT END AS failures FROM documents""",
    "generated_events": f"""SELECT event_id, t AS event_type_Props, e IS NULL AS event_type_Props_validations, e AS event_type_Props_errors FROM (
        SELECT event_id, CASE WHEN {_LEN} % 4 <> 0 THEN '{{"k": ' || {_LEN} % 100 || '}}' ELSE 'no json' END AS t,
          CASE WHEN {_LEN} % 4 = 0 THEN 'not a JSON object' WHEN {_LEN} % 100 > 50 THEN 'k: beyond maximum 50' END AS e FROM events)""",
    "validated_props": """SELECT event_id, e IS NULL AS Props_validations, e AS Props_errors FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not a JSON object' WHEN json_extract_string(props, '$.k') IS NULL THEN 'k: missing'
        WHEN json_extract_string(props, '$.k')::BIGINT > 50 THEN 'k: beyond maximum 50' END AS e FROM events)""",
    "read_embedding_lines": """SELECT input, count(*) AS n, sum(CASE WHEN f THEN 0 ELSE 1 END)::BIGINT AS numbers, round(sum(CASE WHEN f THEN 0 ELSE v END), 3) AS total, count(*) FILTER (f) AS failed FROM (
        SELECT n_name AS input, n_nationkey + 0.5::DOUBLE AS v, n_nationkey % 5 = 0 AS f FROM nation UNION ALL SELECT 'x', 1.0, n_nationkey % 5 = 0 FROM nation) GROUP BY input""",
    "read_chat_lines": """SELECT n_name AS asked, CASE WHEN n_regionkey <> 0 THEN lower(n_name) END AS answer, CASE WHEN n_regionkey <> 0 THEN length(n_name) END AS prompt_tokens, CASE WHEN n_regionkey = 0 THEN 'timeout' END AS error FROM nation""",
}
