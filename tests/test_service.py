import json

import pytest
from pyspark.sql import functions as F

from loomwork.operators import service as sv
from loomwork.sources import tables as tb

FAST = sv.RunnerConfig(max_requests_per_minute=1e9, max_tokens_per_minute=1e12, cool_down_s=0.0, partitions=2, max_attempts=3)
SCHEMA = {"title": "Animals", "properties": {"name": {"type": "string"}, "n": {"type": "integer", "minimum": 0}, "kind": {"type": "string", "enum": ["a", "b"]}}, "required": ["name"]}


def test_embedding_keeps_rows_and_dedupes(spark, tmp_path):
    log = str(tmp_path)

    def send(request):
        import os
        import uuid

        open(os.path.join(log, uuid.uuid4().hex), "w").close()
        if request["input"] == "bad":
            raise RuntimeError("no")
        return {"data": [{"embedding": [float(len(request["input"]))]}]}

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "x", "yy", "bad", None])], "id int, text string")
    out = {r.id: (r["text_text-embedding-3-small_embedding"], r["text_text-embedding-3-small_errors"]) for r in sv.embed_column(df, "text", "text-embedding-3-small", sv.FunctionClient(send), FAST).collect()}
    assert out[0] == out[1] == ([1.0], None) and out[2] == ([2.0], None) and out[4] == (None, None)
    assert out[3][0] is None and out[3][1] == ["RuntimeError: no"] * 3
    assert len(list(tmp_path.iterdir())) == 2 + 3


def test_counts_and_chat(spark):
    def send(request):
        return {"choices": [{"message": {"role": "assistant", "content": request["messages"][1]["content"].upper()}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}

    df = spark.createDataFrame([("a",), ("b",)], "t string")
    out = sv.chat_column(df, "t", "s", "m", sv.FunctionClient(send), FAST)
    assert sorted(r.t_m_answer for r in out.collect()) == ["A", "B"]
    responses = sv.call_service(df.select(F.to_json(F.struct("t")).alias("request")), sv.FunctionClient(lambda r: r), FAST)
    assert sv.response_counts(responses).first().asDict() == {"succeeded": 2, "failed": 0, "attempts": 2, "retries": 0}


def test_budget_refills():
    now = [0.0]
    b = sv.Budget(60, 600, lambda: now[0])
    assert all(b.take(1) == 0 for _ in range(60)) and b.take(1) == pytest.approx(1)
    now[0] = 2.0
    assert b.take(1) == 0
    now[0] = 100.0
    assert b.take(10_000) == 0 and b.take(300) == pytest.approx(30)


def test_validation(spark):
    texts = ['{"name": "x", "n": 3}', '{"n": 1.5, "name": "y"}', "[1]", "no", '{"n": 1}', '{"name": "z", "kind": "c"}', '{"name": "z", "n": -1}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text_Animals string")
    out = {r.i: (r.text_Animals_validations, r.text_Animals_errors) for r in sv.validate_columns(df, SCHEMA).collect()}
    assert out[0] == (True, None)
    assert [out[i][1] for i in range(1, 8)] == ["n: not of type integer", "not a JSON object", "not a JSON object", "name: missing", "kind: none of ['a', 'b']", "n: beyond minimum 0", "no text"]
    assert not any(out[i][0] for i in range(1, 8))


def test_tokens_caps_and_prices(spark):
    df = spark.createDataFrame([("Hello, wörld 42!",), (None,)], "t string")
    assert [r[0] for r in df.select(sv.regex_tokens(F.col("t"))).collect()] == [7, None]
    assert sv.check_input_cap(df, "t", "bge-small-en-v1.5") == 7
    with pytest.raises(ValueError):
        sv.check_input_cap(df, "t", "other")
    with pytest.raises(ValueError):
        sv.check_input_cap(spark.createDataFrame([("a " * 600,)], "t string"), "t", "bge-small-en-v1.5")
    with pytest.raises(ValueError):
        sv.embedding_cost(df, "t", "other")
    with pytest.raises(NotImplementedError):
        sv.request_tokens("images", F.col("t"))
    assert sv.embedding_cost(df, "t", "text-embedding-3-small").first().price == pytest.approx(7 * 2e-8)


def test_generation_parameters():
    sv.check_parameters({"top_p": 0.5, "best_of": 2, "do_sample": True})
    for bad in ({"top_p": 1.0}, {"temperature": 0}, {"best_of": 2}, {"best_of": 2, "do_sample": True, "seed": 1}, {"stop": list("abcde")}, {"frequency_penalty": 3}):
        with pytest.raises(ValueError):
            sv.check_parameters(bad)


def test_generation_and_payloads(spark):
    df = spark.createDataFrame([("cat",)], "text string")
    out = sv.generate_column(df, "text", "s", sv.FunctionClient(lambda r: {"generated_text": json.dumps({"name": r["parameters"]["grammar"]["type"]})}), FAST, SCHEMA).first()
    assert out.text_Animals == '{"name": "json"}' and out.text_Animals_validations
    r = json.loads(df.select(sv.chat_request(sv.chat_messages("s", F.col("text")), "m", SCHEMA)).first()[0])
    assert r["tool_choice"]["function"]["name"] == "Animals" and r["messages"][1] == {"role": "user", "content": "cat"}


def test_result_lines(spark, tmp_path):
    lines = [
        [{"model": "m", "input": ["a", "b"]}, {"data": [{"object": "embedding", "embedding": [1.0]}, {"object": "embedding", "embedding": [2.0]}]}],
        [{"model": "m", "input": "c"}, ["failed"], {"row": 1}],
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = sorted((r.input, r.text_m_embedding, r.errors) for r in tb.read_embedding_results(spark, str(tmp_path / "e.jsonl"), "text").collect())
    assert got == [("a", [1.0], None), ("b", [2.0], None), ("c", [], ["failed"])]
    chat = [[{"messages": [{"role": "user", "content": "q"}]}, {"choices": [{"message": {"role": "assistant", "content": "r"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}}], [{"messages": []}, ["e"]]]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, chat)))
    rows = tb.read_chat_results(spark, str(tmp_path / "c.jsonl")).collect()
    assert rows[0].choice.content == "r" and rows[0].usage.total_tokens == 2 and rows[1].errors == ["e"] and rows[1].choice is None


@pytest.fixture(scope="module")
def server():
    """A service on this machine that answers by what the input says."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = {"calls": [], "limited": set()}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            x = body["input"]
            seen["calls"].append((self.path, x, self.headers.get("Authorization"), self.headers.get("api-key")))
            code, answer = 200, {"data": [{"embedding": [float(len(x))]}]}
            if x.startswith("limited") and x not in seen["limited"]:
                seen["limited"].add(x)
                code, answer = 429, {"error": {"message": "Rate limit reached"}}
            elif x.startswith("error"):
                answer = {"error": {"message": "bad input"}}
            elif x.startswith("broken"):
                code, answer = 500, {"error": {"message": "down"}}
            elif x.startswith("slow"):
                time.sleep(3)
            out = json.dumps(answer).encode()
            try:
                self.send_response(code)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)
            except OSError:
                pass

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_http_client(spark, server):
    url, seen = server
    texts = ["fine", "limited one", "error one", "broken one", "slow one", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    config = sv.RunnerConfig(max_requests_per_minute=1e9, max_tokens_per_minute=1e12, cool_down_s=0.05, partitions=2, max_attempts=2)
    requests = df.select(sv.embedding_request(F.col("t"), "m").alias("request"))
    found = sv.call_service(requests, sv.HttpClient(f"{url}/v1/embeddings", "k", timeout_s=1.0), config)
    by = {json.loads(r.request)["input"]: r for r in found.collect()}
    assert len(by) == 5
    assert json.loads(by["fine"].response)["data"][0]["embedding"] == [4.0] and by["fine"].errors is None
    assert by["limited one"].attempts == 2 and by["limited one"].response and by["limited one"].rate_limit_errors == 1
    assert by["error one"].response is None and by["error one"].api_errors == 2 and "bad input" in by["error one"].errors[0]
    assert by["broken one"].api_errors == 2 and "down" in by["broken one"].errors[1]
    assert by["slow one"].other_errors == 2 and "timed out" in by["slow one"].errors[0].lower()
    assert sv.status_counts(found).first().asDict() == {"started": 5, "in_progress": 0, "succeeded": 2, "failed": 3, "rate_limit_errors": 1, "api_errors": 4, "other_errors": 2}
    assert {c[2] for c in seen["calls"]} == {"Bearer k"}
    sv.call_service(requests.limit(1), sv.HttpClient(f"{url}/openai/deployments/m/embeddings", "k"), config)
    assert seen["calls"][-1][3] == "k" and seen["calls"][-1][2] is None


def test_calls_go_on_while_one_is_slow(spark):
    def send(request):
        import time

        time.sleep(1.0 if request["n"] == 0 else 0.05)
        return {"at": time.monotonic()}

    df = spark.createDataFrame([(json.dumps({"n": n}),) for n in range(21)], "request string").coalesce(1)
    config = sv.RunnerConfig(max_requests_per_minute=1e9, max_tokens_per_minute=1e12, partitions=1, threads=2)
    at = sorted(json.loads(r.response)["at"] for r in sv.call_service(df, sv.FunctionClient(send), config).collect())
    assert at[-1] - at[0] < 1.6


def test_embedding_several_columns_and_names(spark):
    df = spark.createDataFrame([("a", "bb", 1, 2), (None, None, 3, 4), (None, "c", 5, 6)], "x string, y string, _request int, request int")
    out = sv.embed_columns(df, ["x", "y"], ["text-embedding-3-small", "text-embedding-ada-002"], sv.FunctionClient(lambda r: {"data": [{"embedding": [float(len(r["input"]))]}]}), FAST)
    assert len(out.columns) == 4 + 8
    assert sorted((r._request, r.request, (r["y_text-embedding-ada-002_embedding"] or [None])[0]) for r in out.collect()) == [(1, 2, 2.0), (3, 4, None), (5, 6, 1.0)]


def test_result_lines_that_the_engine_wrote(spark, tmp_path):
    df = spark.createDataFrame([("ab",), ("bad",)], "t string")

    def send(r):
        if r["input"] == "bad":
            raise RuntimeError('say "no"')
        return {"data": [{"object": "embedding", "embedding": [1.5]}]}

    found = sv.call_service(df.select(sv.embedding_request(F.col("t"), "m").alias("request")), sv.FunctionClient(send), FAST)
    tb.write_result_lines(found.withColumn("meta", F.lit('{"row": 1}')), str(tmp_path / "out"), "meta")
    got = {r.input: (r.t_m_embedding, r.errors) for r in tb.read_embedding_results(spark, str(tmp_path / "out"), "t").collect()}
    assert got == {"ab": ([1.5], None), "bad": ([], ['RuntimeError: say "no"'] * 3)}
    tb.write_result_lines(found, str(tmp_path / "out"))
    assert tb.read_embedding_results(spark, str(tmp_path / "out"), "t").count() == 4


def test_nested_schemas(spark):
    schema = {
        "title": "Zoo",
        "properties": {
            "name": {"type": "string", "minLength": 2, "pattern": "^[A-Z]"},
            "keeper": {"type": "object", "properties": {"age": {"type": "integer", "minimum": 18}}, "required": ["age"]},
            "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}, "maxItems": 2},
            "cages": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}},
        },
        "required": ["name"],
        "additionalProperties": False,
    }
    cases = {
        '{"name": "Berlin", "keeper": {"age": 40}, "tags": ["a", "bcd"], "cages": [{"n": 1}]}': None,
        '{"name": "B"}': "name: beyond minLength 2",
        '{"name": "berlin"}': "name: not like ^[A-Z]",
        '{"name": "Bern", "keeper": {"age": 3}}': "keeper.age: beyond minimum 18",
        '{"name": "Bern", "keeper": {}}': "keeper.age: missing",
        '{"name": "Bern", "keeper": 3}': "keeper: not of type object",
        '{"name": "Bern", "tags": ["abcd"]}': "tags[]: beyond maxLength 3",
        '{"name": "Bern", "tags": ["a", "b", "c"]}': "tags: beyond maxItems 2",
        '{"name": "Bern", "cages": [{"n": 1}, {"n": "x"}]}': "cages[].n: not of type integer",
        '{"name": "Bern", "cages": [{"n": 1}, {}]}': "cages[].n: missing",
        '{"name": "Bern", "other": 1}': "object: unknown fields",
    }
    df = spark.createDataFrame([(t,) for t in cases], "Zoo string")
    assert {r.Zoo: r.Zoo_errors for r in sv.validate_column(df, "Zoo", schema).collect()} == cases


def test_names_and_many_texts_in_token_counts(spark):
    df = spark.createDataFrame([([("user", "a b", None), ("user", "c", "big bob")], ["one two", "three"])], "m array<struct<role:string,content:string,name:string>>, t array<string>")
    r = df.select(sv.message_tokens(F.col("m"), named=True).alias("m"), sv.request_tokens("completions", F.col("t"), many=True).alias("c"), sv.request_tokens("embeddings", F.col("t"), many=True).alias("e")).first()
    assert (r.m, r.c, r.e) == (2 + 15 + (4 + 1 + 2) + (4 + 1 + 1 + 2 - 1), 3 + 30, 3)


def test_tiktoken_counts(spark, tmp_path):
    import base64

    pytest.importorskip("tiktoken")
    ranks = [bytes([b]) for b in range(256)] + [b"th", b"the"]
    (tmp_path / "ranks").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(ranks)))
    count = sv.tiktoken_counter(str(tmp_path / "ranks"), r"\S+|\s+")
    df = spark.createDataFrame([("the thing",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(count(F.col("t"))).collect()] == [6, None, 0]


def test_command_line(spark, server, tmp_path):
    from loomwork import cli

    lines = [{"model": "m", "input": "abc", "metadata": {"row": 1}}, {"model": "m", "input": "abc", "metadata": {"row": 2}}, {"model": "m", "input": "error x"}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    counts = cli.main([str(tmp_path / "in.jsonl"), str(tmp_path / "out"), "--url", f"{server[0]}/v1/embeddings", "--attempts", "2", "--requests-per-minute", "100000", "--partitions", "2"], spark)
    assert (counts["started"], counts["succeeded"], counts["failed"], counts["api_errors"]) == (2, 1, 1, 2)
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=str)
    assert [x[2] for x in got if len(x) == 3] == [{"row": 1}, {"row": 2}] and len(got) == 3
