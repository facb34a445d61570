"""The stateless operators over streams, and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.sources.tables import shared_folder


def read_stream(spark: SparkSession, pattern: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def tumbling(events: DataFrame, ts: str = "ts", length: str = "1 hour", late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, by, n, total) of each window once the watermark has passed it."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """(session_start, session_end, by, n)."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.session_window("_ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def unique_requests(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark, so that a repeated request is sent once."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def prompts(events: DataFrame, template: str, values: list, name: str = "prompt") -> DataFrame:
    """The prompt operator is stateless: the same on a stream."""
    return tx.prompt(events, template, values, name)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what there is into Parquet, exactly once, and returns the table."""
    import uuid

    folder = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
