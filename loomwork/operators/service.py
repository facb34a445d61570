"""Embedding and generation columns through a service.

Requests are deduplicated by content, sent from Arrow batches by a pluggable client with retries and
a rate budget, and joined back, so equal texts cost one call and no row is multiplied. Failures are
data: a response has errors instead of a body. Responses are written to the shared folder before use,
so a retry downstream never repeats a paid call.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import text as tx
from loomwork.operators.folds import with_row_index
from loomwork.operators.joins import free_name
from loomwork.sources.tables import materialised

#: Tokens that a model takes at most.
MAX_INPUT = dict.fromkeys(("text-embedding-ada-002", "text-embedding-3-large", "text-embedding-3-small"), 8191)
MAX_INPUT |= {"bge-small-en-v1.5": 512, "voyage-code-2": 16_000} | dict.fromkeys(["togethercomputer/m2-bert-80M-32k-retrieval"], 32_000)
#: US dollars a token.
PRICE = {"ada v2": 1e-7, "text-embedding-ada-002": 1e-7, "text-embedding-3-large": 1.3e-7, "text-embedding-3-small": 2e-8}


class RateLimited(Exception):
    """The service asks to slow down."""


class ApiError(RuntimeError):
    """The service answered with an error."""


class Client(Protocol):
    """Sends one request and returns the response; raises on failure. Pickled to the executors."""

    def send(self, request: dict) -> dict: ...


@dataclass(frozen=True)
class FunctionClient:
    """A function of the request, for tests and local models."""

    function: Callable[[dict], dict]

    def send(self, request: dict) -> dict:
        return self.function(request)


@dataclass(frozen=True)
class HttpClient:
    """POSTs JSON; ``api-key`` header for deployments, a bearer token otherwise."""

    url: str
    key: str = field(repr=False)
    timeout_s: float = 60.0

    def send(self, request: dict) -> dict:
        headers = {"Content-Type": "application/json"}
        headers |= {"api-key": self.key} if "/deployments" in self.url else {"Authorization": f"Bearer {self.key}"}
        call = urllib.request.Request(self.url, json.dumps(request).encode(), headers)
        try:
            with urllib.request.urlopen(call, timeout=self.timeout_s) as r:
                body = json.load(r)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(e.reason) from e
            try:
                body = json.load(e)
            except ValueError:
                raise ApiError(f"{e.code} {e.reason}") from e
            body = body if isinstance(body, dict) and "error" in body else {"error": f"{e.code} {e.reason}"}
        if isinstance(body, dict) and "error" in body:
            message = str(body["error"])
            raise RateLimited(message) if "rate limit" in message.lower() else ApiError(message)
        return body


@dataclass(frozen=True)
class RunnerConfig:
    """Limits are global; each of ``partitions`` tasks gets an equal share, so they hold however many run."""

    max_requests_per_minute: float = 100.0
    max_tokens_per_minute: float = 1_000_000.0
    max_attempts: int = 5
    cool_down_s: float = 15.0
    partitions: int = 8
    threads: int = 8


class Budget:
    """Requests and tokens that refill continuously."""

    def __init__(self, requests_per_minute: float, tokens_per_minute: float, clock: Callable[[], float] = time.monotonic):
        self.rate = requests_per_minute / 60, tokens_per_minute / 60
        self.most = max(requests_per_minute, 1.0), tokens_per_minute
        self.left = [*self.most]
        self.clock, self.at = clock, clock()

    def take(self, tokens: float) -> float:
        """0 if the request may go now, else the seconds to wait. A request beyond the whole budget goes when it is full."""
        now = self.clock()
        self.left = [min(m, x + r * (now - self.at)) for m, x, r in zip(self.most, self.left, self.rate)]
        self.at = now
        need = 1.0, min(tokens, self.most[1])
        wait = max((n - x) / r if n > x else 0.0 for n, x, r in zip(need, self.left, self.rate))
        if wait <= 0:
            self.left = [x - n for x, n in zip(self.left, need)]
        return max(wait, 0.0)


RESPONSE = {"request": "string", "response": "string", "errors": "array<string>", "attempts": "int", "rate_limit_errors": "int", "api_errors": "int", "other_errors": "int"}


def call_service(requests: DataFrame, client: Client, config: RunnerConfig = RunnerConfig(), column: str = "request", tokens: str | None = None) -> DataFrame:
    """(request, response, errors, attempts, errors by kind, id) of each distinct JSON request; written before it is returned.
    ``id`` is the request's MD5.

    A task keeps ``threads`` calls under way: whenever one ends the next goes, as the budget allows, retries
    before new requests; after a rate limit nothing new goes for ``cool_down_s``. ``tokens``: a
    column with a request's token count for the budget.
    """
    rows = requests.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("request")).agg(F.max(tokens).cast("double").alias("tokens") if tokens else F.lit(0.0).alias("tokens"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = Budget(config.max_requests_per_minute / config.partitions, config.max_tokens_per_minute / config.partitions)

        def attempt(request: str) -> tuple[Any, str | None, int | None]:
            """The body, or an error and its kind: 0 rate limit, 1 the service's, 2 any other."""
            try:
                return client.send(json.loads(request)), None, None
            except RateLimited as e:
                kind, error = 0, e
            except ApiError as e:
                kind, error = 1, e
            except Exception as e:  # any failure of a request is its result
                kind, error = 2, e
            return None, f"{type(error).__name__}: {error}", kind

        with ThreadPoolExecutor(config.threads) as pool:
            for frame in frames:
                out, rest_until = [], 0.0
                fresh = deque((r, t, [], [0, 0, 0]) for r, t in zip(frame["request"], frame["tokens"]))
                again: deque = deque()
                under_way: dict = {}
                while fresh or again or under_way:
                    pause = 0.0
                    while (fresh or again) and len(under_way) < config.threads:
                        queue = again or fresh
                        pause = max(rest_until - time.monotonic(), 0.0) or budget.take(queue[0][1])
                        if pause:
                            break
                        task = queue.popleft()
                        under_way[pool.submit(attempt, task[0])] = task
                    if not under_way:
                        time.sleep(pause)
                        continue
                    for call in wait(under_way, timeout=pause or None, return_when=FIRST_COMPLETED).done:
                        r, t, errors, kinds = under_way.pop(call)
                        body, error, kind = call.result()
                        if error is None:
                            out.append((r, json.dumps(body), None, len(errors) + 1, *kinds))
                            continue
                        errors, kinds = [*errors, error], [k + (i == kind) for i, k in enumerate(kinds)]
                        if kind == 0:
                            rest_until = time.monotonic() + config.cool_down_s
                        if len(errors) < config.max_attempts:
                            again.append((r, t, errors, kinds))
                        else:
                            out.append((r, None, errors, len(errors), *kinds))
                yield pd.DataFrame(out, columns=list(RESPONSE))

    answered = rows.repartition(config.partitions).mapInPandas(run, ", ".join(f"{k} {v}" for k, v in RESPONSE.items()))
    return materialised(answered.withColumn("id", F.md5("request")), "responses")


def status_counts(responses: DataFrame) -> DataFrame:
    """The counters of a run in one row: started, in_progress (0, as a run is over when it returns), succeeded, failed, rate_limit_errors,
    api_errors and other_errors."""
    done = [F.count("*").alias("started"), F.lit(0).cast("long").alias("in_progress"), F.count("response").alias("succeeded"), F.count_if(F.col("response").isNull()).alias("failed")]
    return responses.agg(*done, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rate_limit_errors", "api_errors", "other_errors")))


def response_counts(responses: DataFrame) -> DataFrame:
    """Succeeded, failed, attempts and retries."""
    return responses.agg(F.count("response").alias("succeeded"), F.count_if(F.col("response").isNull()).alias("failed"), F.sum("attempts").alias("attempts"), F.sum(F.col("attempts") - 1).alias("retries"))


def embedding_request(column: Column, model: str) -> Column:
    return F.when(column.isNotNull(), F.to_json(F.struct(F.lit(model).alias("model"), column.alias("input"))))


def batched_embedding_requests(df: DataFrame, key: str, column: str, model: str, size: int = 100) -> DataFrame:
    """(batch, request): ``size`` consecutive rows by ``key`` per request."""
    rows = with_row_index(df.select(key, column), [key], "_i").withColumn("batch", F.floor(F.col("_i") / size))
    batch = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_i", column))).alias("x"))  # size rows a group
    return batch.select("batch", F.to_json(F.struct(F.lit(model).alias("model"), F.col("x").getField(column).alias("input"))).alias("request"))


def chat_messages(system: str, user: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def function_call(schema: dict) -> dict:
    """The fields that make an answer follow a JSON schema: one function, to be called."""
    name = schema.get("title", "answer")
    function = dict(parameters=schema, description=schema.get("description", ""), name=name)
    return dict(tool_choice=dict(function=dict(name=name), type="function"), tools=[dict(function=function, type="function")])


def chat_request(messages: Column, model: str, schema: dict | None = None) -> Column:
    """A chat request; ``schema``: a JSON schema the answer must follow, as a function to call."""
    fields = [F.lit(model).alias("model"), messages.alias("messages")]
    if schema:
        head = F.to_json(F.struct(*fields))
        return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(", " + json.dumps(function_call(schema))[1:]))
    return F.to_json(F.struct(*fields))


def _answered(df: DataFrame, request: Column, client: Client, config: RunnerConfig, made: Callable[[DataFrame], list[Column]]) -> DataFrame:
    """``df`` with the columns that ``made`` takes from the responses. Rows and responses meet on the MD5 of the request, so request
    texts aren't joined; rows without a request get a key of their own, so that they don't meet in one task."""
    key = free_name(df, "_request")
    found = call_service(df.select(request.alias("request")), client, config)
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    none = F.concat(F.lit("-"), F.xxhash64(*plain).cast("string")) if plain else F.lit("-")
    side = found.select(F.col("id").alias(key), *made(found))
    return df.withColumn(key, F.coalesce(F.md5(request), none)).join(side, key, "left").select(*df.columns, *side.columns[1:])


def embed_column(df: DataFrame, column: str, model: str, client: Client, config: RunnerConfig = RunnerConfig(), check_cap: bool = True) -> DataFrame:
    """``df`` with ``{column}_{model}_embedding`` (null where the call failed) and ``{column}_{model}_errors``."""
    if check_cap:
        check_input_cap(df, column, model)
    body = F.from_json("response", "struct<data:array<struct<embedding:array<double>>>>")
    vector = F.get(body["data"], F.lit(0))["embedding"]
    name = f"{column}_{model}"
    return _answered(df, embedding_request(F.col(column), model), client, config, lambda _: [vector.alias(f"{name}_embedding"), F.col("errors").alias(f"{name}_errors")])


def embed_columns(df: DataFrame, columns: list[str], models: list[str], client: Client, config: RunnerConfig = RunnerConfig()) -> DataFrame:
    for c in columns:
        for m in models:
            df = embed_column(df, c, m, client, config)
    return df


def chat_column(df: DataFrame, column: str, system: str, model: str, client: Client, config: RunnerConfig = RunnerConfig(), schema: dict | None = None) -> DataFrame:
    """``df`` with ``{column}_{model}_answer`` (content, or the called function's arguments), ``_usage`` and ``_errors``."""
    body = F.from_json(
        "response",
        "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<function:struct<arguments:string>>>>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>",
    )
    message = F.get(body["choices"], F.lit(0))["message"]
    answer = F.coalesce(F.get(message["tool_calls"], F.lit(0))["function"]["arguments"], message["content"])
    name = f"{column}_{model}"
    request = chat_request(chat_messages(system, F.col(column)), model, schema)
    return _answered(df, request, client, config, lambda _: [answer.alias(f"{name}_answer"), body["usage"].alias(f"{name}_usage"), F.col("errors").alias(f"{name}_errors")])


def generation_request(system: Column, user: Column, schema: dict | None = None, max_new_tokens: int = 1024, **parameters: Any) -> Column:
    """A text-generation request: prompt, stop sequence, and a JSON grammar if there is a schema."""
    check_parameters(parameters)
    fixed = {"max_new_tokens": max_new_tokens, "stop": ["<|eot_id|>"], **parameters}
    if schema:
        fixed["grammar"] = {"type": "json", "value": schema}
    head = F.to_json(F.struct(tx.chat_template(system, user).alias("inputs")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "parameters": ' + json.dumps(fixed) + "}"))


def check_parameters(p: dict[str, Any]) -> None:
    """Rules of generation parameters; ValueError names the first that fails."""
    between = lambda name, low, high: name not in p or p[name] is None or low < p[name] < high
    rules = {
        "0 < top_p < 1": between("top_p", 0, 1),
        "0 < typical_p < 1": between("typical_p", 0, 1),
        "temperature > 0": between("temperature", 0, math.inf),
        "repetition_penalty > 0": between("repetition_penalty", 0, math.inf),
        "-2 <= frequency_penalty <= 2": abs(p.get("frequency_penalty") or 0) <= 2,
        "top_k > 0": between("top_k", 0, math.inf),
        "max_new_tokens > 0": between("max_new_tokens", 0, math.inf),
        "truncate > 0": between("truncate", 0, math.inf),
        "seed >= 0": between("seed", -1, math.inf),
        "best_of > 0": between("best_of", 0, math.inf),
        "top_n_tokens > 0": between("top_n_tokens", 0, math.inf),
        "at most 4 stop sequences": len(p.get("stop") or []) <= 4,
        "best_of > 1 samples without a seed": not (p.get("best_of") or 0) > 1 or (p.get("seed") is None and any(p.get(k) for k in ("do_sample", "temperature", "top_k", "top_p", "typical_p"))),
    }
    for rule, holds in rules.items():
        if not holds:
            raise ValueError(rule)


def generate_column(df: DataFrame, column: str, system: str, client: Client, config: RunnerConfig = RunnerConfig(), schema: dict | None = None, **parameters: Any) -> DataFrame:
    """``df`` with ``{column}_{title}``, the generated text, and with a schema ``_validations`` and ``_errors``."""
    title = (schema or {}).get("title", "generation")
    out = f"{column}_{title}"
    request = generation_request(F.lit(system), F.col(column), schema, **parameters)
    joined = _answered(df, request, client, config, lambda _: [F.get_json_object("response", "$.generated_text").alias(out)])
    return validate_column(joined, out, schema) if schema else joined


_PATTERN = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$", "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{"}


def _of_kind(value: Column, kind: str) -> Column:
    return value.rlike(_PATTERN[kind]) if kind in _PATTERN else value.isNotNull()


def _value_problems(name: str, rule: dict, value: Column, there: Column) -> list[Column]:
    """Error texts, null where a rule holds, of one JSON value: types, enum, bounds, lengths, pattern, and what is inside."""
    out = []
    options = [r.get("type") for r in rule.get("anyOf", [rule])]
    kinds = [o for o in options if o and o != "null"]
    if kinds:
        bad = reduce(lambda a, b: a & b, (~_of_kind(value, k) for k in kinds))
        absent = value.isNull() if "null" in options else F.lit(False)
        out.append(F.when(there & ~absent & F.coalesce(bad, F.lit(True)), F.lit(f"{name}: not of type {' or '.join(kinds)}")))
    if "enum" in rule:
        out.append(F.when(there & ~value.isin(*map(str, rule["enum"])), F.lit(f"{name}: none of {rule['enum']}")))
    number = value.try_cast("double")
    for word, beyond in (("minimum", lambda b: number < b), ("maximum", lambda b: number > b), ("exclusiveMinimum", lambda b: number <= b), ("exclusiveMaximum", lambda b: number >= b)):
        if word in rule:
            out.append(F.when(beyond(F.lit(float(rule[word]))), F.lit(f"{name}: beyond {word} {rule[word]}")))
    for word, beyond in (("minLength", lambda b: F.char_length(value) < b), ("maxLength", lambda b: F.char_length(value) > b)):
        if word in rule:
            out.append(F.when(there & beyond(rule[word]), F.lit(f"{name}: beyond {word} {rule[word]}")))
    if "pattern" in rule:
        out.append(F.when(there & ~value.rlike(rule["pattern"]), F.lit(f"{name}: not like {rule['pattern']}")))
    if rule.get("properties"):
        out += [F.when(there & value.startswith("{"), p) for p in _problems(rule, value, f"{name}.")]
    if "array" in kinds:
        items = F.from_json(F.when(value.startswith("["), value), "array<string>")
        for word, beyond in (("minItems", lambda b: F.size(items) < b), ("maxItems", lambda b: F.size(items) > b)):
            if word in rule:
                out.append(F.when(there & beyond(rule[word]), F.lit(f"{name}: beyond {word} {rule[word]}")))
        inside = rule.get("items", {})
        if inside:
            first = F.filter(F.transform(items, lambda x: F.coalesce(*_value_problems(f"{name}[]", inside, x, F.lit(True)), F.lit(None).cast("string"))), lambda p: p.isNotNull())
            out.append(F.get(first, F.lit(0)))
    return out


def _problems(schema: dict, raw: Column, path: str = "") -> list[Column]:
    """Error texts, null where a rule holds, of a JSON schema: required, additional and all properties, nested ones too."""
    out = []
    fields = F.json_object_keys(raw)
    known = schema.get("properties", {})
    for name, rule in known.items():
        there = F.array_contains(fields, name)
        if name in schema.get("required", []):
            out.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(f"{path}{name}: missing")))
        out += _value_problems(path + name, rule, F.get_json_object(raw, f"$['{name}']"), there)
    if schema.get("additionalProperties") is False:
        out.append(F.when(F.size(F.array_except(fields, F.array(*map(F.lit, known)))) > 0, F.lit(f"{path or 'object'}: unknown fields")))
    return out


def validate_column(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """``df`` with ``{column}_validations`` and ``{column}_errors`` (null if valid); built-in functions only. Of a type ``string`` it is
    only known that there is a value."""
    raw = F.col(column)
    is_object = F.json_object_keys(raw).isNotNull()
    problems = F.array_compact(F.array(*_problems(schema, raw))) if schema.get("properties") else F.array().cast("array<string>")
    errors = F.when(raw.isNull(), F.lit("no text")).when(~F.coalesce(is_object, F.lit(False)), F.lit("not a JSON object")).when(F.size(problems) > 0, F.array_join(problems, "; "))
    return df.withColumn(f"{column}_errors", errors).withColumn(f"{column}_validations", F.col(f"{column}_errors").isNull())


def validate_columns(df: DataFrame, schema: dict) -> DataFrame:
    """All string columns whose name has the schema's title."""
    for f in df.schema:
        if schema["title"] in f.name and isinstance(f.dataType, T.StringType) and not f.name.endswith("_errors"):
            df = validate_column(df, f.name, schema)
    return df


def regex_tokens(text: Column) -> Column:
    """The default token count: words and marks of the text."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]")).cast("long")


def tiktoken_counter(path: str, pattern: str) -> Callable[[Column], Column]:
    """A token count from a rank file of a byte-level BPE, as an Arrow UDF."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        if path not in _ENCODINGS:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        e = _ENCODINGS[path]
        return s.map(lambda x: None if x is None else len(e.encode_ordinary(x)))

    return count


_ENCODINGS: dict[str, Any] = {}


def message_tokens(messages: Column, count: Callable[[Column], Column] = regex_tokens, n: int = 1, max_tokens: int = 15, named: bool = False) -> Column:
    """Tokens of a chat request: 4 a message and those of its values, 2, and n * max_tokens. ``named``: the messages have a field
    ``name``; where it isn't null its tokens count, and one less for the role it stands for."""

    def one(m: Column) -> Column:
        plain = F.lit(4).cast("long") + count(m["role"]) + count(m["content"])
        return plain + F.coalesce(count(m["name"]) - 1, F.lit(0).cast("long")) if named else plain

    return F.aggregate(F.transform(messages, one), F.lit(2 + n * max_tokens).cast("long"), lambda a, x: a + x)


def request_tokens(kind: str, text: Column, count: Callable[[Column], Column] = regex_tokens, n: int = 1, max_tokens: int = 15, many: bool = False) -> Column:
    """Tokens of a ``completions`` (n * max_tokens for each text beside its own) or ``embeddings`` request; ``many``: ``text`` is an array
    of texts, and ``count`` made of built-in functions."""
    if kind not in ("completions", "embeddings"):
        raise NotImplementedError(f"no token count for {kind}")
    extra = n * max_tokens if kind == "completions" else 0
    if many:
        return F.aggregate(F.transform(text, lambda x: count(x) + F.lit(extra)), F.lit(0).cast("long"), lambda a, x: a + x)
    return count(text) + F.lit(extra)


def embedding_cost(df: DataFrame, column: str, model: str, count: Callable[[Column], Column] = regex_tokens) -> DataFrame:
    """``df`` with ``tokens`` and ``price``."""
    if model not in PRICE:
        raise ValueError(f"no price for {model}; known: {', '.join(PRICE)}")
    return df.withColumn("tokens", count(F.col(column))).withColumn("price", F.col("tokens") * PRICE[model])


def check_input_cap(df: DataFrame, column: str, model: str, count: Callable[[Column], Column] = regex_tokens) -> int:
    """The longest text in tokens; ValueError for an unknown model, or beyond its cap."""
    if model not in MAX_INPUT:
        raise ValueError(f"unknown model {model}; known: {', '.join(MAX_INPUT)}")
    most = df.agg(F.max(count(F.col(column)))).first()[0] or 0
    if most > MAX_INPUT[model]:
        raise ValueError(f"{column} has a text of {most} tokens; {model} takes {MAX_INPUT[model]}")
    return most

