"""Exact quantiles of any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.tables import materialised


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], out: str = "q") -> DataFrame:
    """(by, ``out``): the quantiles of the non-null values of each group, linear between ranks, as array<double>; null groups are groups.

    Equal values are counted first. The counts are range-partitioned by group and value and written; running sums
    inside a partition, and over the partitions' totals, are the ranks. So neither a group nor a column is ever
    in one task or one aggregation buffer.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    counts = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialised(counts.repartitionByRange(n, *keys, "_v").withColumn("_part", F.spark_partition_id()), "counts")
    one = keys or [F.lit(0)]
    sizes = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*one).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), F.sum("_s").over(Window.partitionBy(*one)).alias("_n"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = placed.alias("l").join(sizes.alias("r"), [F.col("l._part") == F.col("r._part"), *same]).select("l.*", "_off", "_n")
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = joined.withColumn("_end", F.sum("_c").over(inside) + F.col("_off")).withColumn("_start", F.col("_end") - F.col("_c"))
    lower = [(F.floor((F.col("_n") - 1) * F.lit(float(p))), F.ceil((F.col("_n") - 1) * F.lit(float(p)))) for p in probabilities]
    at = lambda k: F.max(F.when((F.col("_start") <= k) & (k < F.col("_end")), F.col("_v")))
    found = ranks.groupBy(*keys).agg(F.max("_n").alias("_n"), *(at(k).alias(f"_{side}{i}") for i, pair in enumerate(lower) for side, k in zip("ab", pair)))
    share = [(F.col("_n") - 1) * F.lit(float(p)) - low for p, (low, _) in zip(probabilities, lower)]
    values = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * s for i, s in enumerate(share)]
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), F.array(*values).alias(out))


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float] | None]:
    """The quantiles of each column; None for a column without values."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("x")).select("x.i", "x.v")
    found = {r.i: list(r.q) for r in quantiles(rows, ["i"], "v", probabilities).collect()}  # a row a column
    return {c: found.get(i) for i, c in enumerate(columns)}
