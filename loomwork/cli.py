"""python -m loomwork.cli REQUESTS OUT --url URL: sends the requests of a JSON-lines file and writes result lines.

A request may have a field ``metadata``, which isn't sent and comes back as the third element of its result line. Equal
requests are sent once; each gets its line.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import endpoint_of
from loomwork.operators import service as sv
from loomwork.session import prepare
from loomwork.sources.tables import write_result_lines


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(request, metadata) of each line."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for line in f["value"]:
                x = json.loads(line)
                metadata = x.pop("metadata", None)
                rows.append((json.dumps(x), None if metadata is None else json.dumps(metadata)))
            yield pd.DataFrame(rows, columns=["request", "metadata"])

    return spark.read.text(path).where("trim(value) != ''").mapInPandas(split, "request string, metadata string")


def run(spark: SparkSession, requests: str, out: str, client: sv.Client, config: sv.RunnerConfig) -> dict:
    """The counters of the run, whose result lines are appended to the folder ``out``."""
    asked = read_requests(spark, requests)
    found = sv.call_service(asked, client, config)
    lines = asked.select(F.md5("request").alias("id"), "metadata").join(found, "id")
    write_result_lines(lines, out, "metadata")
    return sv.status_counts(found).first().asDict()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("requests")
    p.add_argument("out")
    p.add_argument("--url", required=True)
    p.add_argument("--key-variable", default="SERVICE_KEY", help="the environment variable that has the key")
    p.add_argument("--requests-per-minute", type=float, default=1500)
    p.add_argument("--tokens-per-minute", type=float, default=125_000)
    p.add_argument("--attempts", type=int, default=5)
    p.add_argument("--partitions", type=int, default=8)
    a = p.parse_args(args)
    spark = prepare(spark or SparkSession.builder.getOrCreate())
    if spark.range(1).select(endpoint_of(F.lit(a.url))).first()[0] is None and a.url.startswith("https://"):
        raise ValueError(f"no endpoint in {a.url}")
    client = sv.HttpClient(a.url, os.environ.get(a.key_variable, ""))
    counts = run(spark, a.requests, a.out, client, sv.RunnerConfig(a.requests_per_minute, a.tokens_per_minute, a.attempts, partitions=a.partitions))
    print(json.dumps(counts))
    return counts


if __name__ == "__main__":
    main()
