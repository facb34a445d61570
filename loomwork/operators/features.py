"""Feature declarations, dictionary encoding and scalers.

Scalers are fitted by SQL aggregates with population statistics, by exact quantiles (robust), and
applied as column expressions; ``fit`` returns a plain object that can be saved or inspected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.quantiles import column_quantiles
from loomwork.operators.folds import with_row_index
from loomwork.operators.joins import null_safe_join

#: Distinct values that the driver sorts.
SMALL = 10_000
SCALERS = ("standard", "minmax", "maxabs", "robust", "normalizer", "power", "quantile")


def _need(df: DataFrame, name: str, kinds: tuple, what: str) -> None:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    if not isinstance(df.schema[name].dataType, kinds):
        raise ValueError(f"{name} is {df.schema[name].dataType.simpleString()}, not {what}")


@dataclass(frozen=True)
class Numerical:
    column: str
    scaler: str | None = "standard"

    def check(self, df: DataFrame) -> None:
        _need(df, self.column, (T.NumericType, T.BooleanType), "a number")
        if self.scaler is not None and self.scaler not in SCALERS:
            raise ValueError(f"{self.scaler} is none of {', '.join(SCALERS)}")


@dataclass(frozen=True)
class Embedding:
    """``size``: the width every vector must have."""

    column: str
    size: int
    scaler: str | None = None

    def check(self, df: DataFrame) -> None:
        _need(df, self.column, (T.ArrayType,), "an array of numbers")
        if not isinstance(df.schema[self.column].dataType.elementType, (T.FloatType, T.DoubleType)):
            raise ValueError(f"{self.column} has no floating-point elements")
        if not df.where(F.size(self.column) != self.size).isEmpty():
            raise ValueError(f"{self.column} has vectors that aren't {self.size} wide")


@dataclass(frozen=True)
class Categorical:
    column: str
    one_hot: bool = True

    def check(self, df: DataFrame) -> None:
        kinds = (T.StringType, T.IntegralType) if self.one_hot else (T.FloatType, T.DoubleType)
        _need(df, self.column, kinds, "text or an integer" if self.one_hot else "a floating-point code")


@dataclass(frozen=True)
class FeatureSet:
    numerical: tuple[Numerical, ...] = ()
    embeddings: tuple[Embedding, ...] = ()
    categorical: tuple[Categorical, ...] = ()

    @property
    def features(self) -> tuple:
        return (*self.numerical, *self.embeddings, *self.categorical)

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.features]

    @property
    def name(self) -> str:
        return "_".join(sorted(self.columns))

    def check(self, df: DataFrame) -> None:
        for f in self.features:
            f.check(df)


@dataclass(frozen=True)
class InputConfig:
    feature_sets: tuple[FeatureSet, ...]
    target: str = "target"
    folder: str | None = None


def needed_columns(df: DataFrame, c: InputConfig, groups: tuple[str, ...] = (), key: str = "cv_index") -> DataFrame:
    return df.select(*dict.fromkeys([key, c.target, *(x for s in c.feature_sets for x in s.columns), *groups]))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): dense codes of the distinct values in sorted order. Null has none.

    Up to SMALL values are sorted on the driver; more are ranked by range partitions, which are written.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    few = values.limit(SMALL + 1).collect()
    if len(few) > SMALL:
        return with_row_index(values, ["value"], "code")
    schema = T.StructType([T.StructField("value", values.schema["value"].dataType), T.StructField("code", T.LongType())])
    order = sorted((r["value"] for r in few), key=lambda v: v.encode() if isinstance(v, str) else v)  # strings by their bytes, as in SQL
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], schema)


def low_cardinality(df: DataFrame, threshold: float = 0.2) -> list[str]:
    """String columns whose distinct values are at most ``threshold`` of the rows: one aggregate for all."""
    if not 0 < threshold < 1:
        raise ValueError("0 < threshold < 1 is needed")
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    row = df.agg(F.count("*").alias("n"), *(F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if row["n"] and row[f"d{i}"] and row[f"d{i}"] / row["n"] <= threshold]


def encode_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as codes of their dictionaries."""
    out = df
    for c in columns:
        codes = dictionary(df, c).withColumnRenamed("value", c).withColumnRenamed("code", f"_code_{c}")
        out = null_safe_join(out, codes, [c], "left").withColumn(c, F.col(f"_code_{c}")).drop(f"_code_{c}")
    return out.select(*df.columns)


def one_hot(value: Column, categories: list) -> Column:
    """Full-width indicator array; an unknown value is an error."""
    hot = F.array(*((value == c).cast("double") for c in categories))
    return F.when(value.isin(*categories), hot).otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(value.cast("string"), F.lit("null")))))


@dataclass
class Scaler:
    """``parameters``: (shift, scale) by column, or what the kind needs."""

    kind: str
    columns: list[str]
    parameters: dict[str, tuple] = field(default_factory=dict)

    def fit(self, df: DataFrame, quantiles: int = 1000) -> Scaler:
        x = {c: F.col(c).cast("double") for c in self.columns}
        if self.kind == "standard":
            aggs = {c: (F.avg(v), F.stddev_pop(v)) for c, v in x.items()}
        elif self.kind == "minmax":
            aggs = {c: (F.min(v), F.max(v) - F.min(v)) for c, v in x.items()}
        elif self.kind == "maxabs":
            aggs = {c: (F.lit(0.0), F.max(F.abs(v))) for c, v in x.items()}
        elif self.kind == "robust":
            found = {c: q or [0.0] * 3 for c, q in column_quantiles(df, self.columns, [0.25, 0.5, 0.75]).items()}
            self.parameters = {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in found.items()}
            return self
        elif self.kind == "quantile":
            found = column_quantiles(df, self.columns, [i / quantiles for i in range(quantiles + 1)])
            self.parameters = {c: tuple(q or ()) for c, q in found.items()}
            return self
        elif self.kind == "power":
            self.parameters = {c: self._power(df, v) for c, v in x.items()}
            return self
        elif self.kind == "normalizer":
            return self
        else:
            raise ValueError(f"{self.kind} is none of {', '.join(SCALERS)}")
        row = df.agg(*(a.alias(f"{c}_{i}") for c, pair in aggs.items() for i, a in enumerate(pair))).first()
        self.parameters = {c: (row[f"{c}_0"] or 0.0, row[f"{c}_1"] or 1.0) for c in self.columns}
        return self

    @staticmethod
    def _yeo_johnson(x: Column, lam: float) -> Column:
        up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).otherwise(down)

    def _power(self, df: DataFrame, x: Column) -> tuple[float, float, float]:
        """lambda by three rounds of a grid on the log-likelihood, each one aggregate; then mean and deviation."""
        low, high = -4.0, 6.0
        best = 1.0
        for _ in range(3):
            grid = np.linspace(low, high, 21)
            sign = F.sum(F.signum(x) * F.log1p(F.abs(x)))
            row = df.agg(F.count(x).alias("n"), sign.alias("s"), *(F.var_pop(self._yeo_johnson(x, float(g))).alias(f"v{i}") for i, g in enumerate(grid))).first()
            score = [(g - 1) * (row["s"] or 0) - row["n"] / 2 * np.log(row[f"v{i}"]) if row[f"v{i}"] and np.isfinite(row[f"v{i}"]) else -np.inf for i, g in enumerate(grid)]
            best = float(grid[int(np.argmax(score))]) if np.isfinite(max(score)) else 1.0
            step = (high - low) / 20
            low, high = best - step, best + step
        y = self._yeo_johnson(x, best)
        row = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("d")).first()
        return best, row["m"] or 0.0, row["d"] or 1.0

    def scaled(self, column: str) -> Column:
        x = F.col(column).cast("double")
        if self.kind == "normalizer":
            length = F.sqrt(sum((F.pow(F.col(c).cast("double"), 2) for c in self.columns), F.lit(0.0)))
            return F.when(length == 0, 0.0).otherwise(x / length)
        if self.kind == "power":
            lam, mean, dev = self.parameters[column]
            return (self._yeo_johnson(x, lam) - mean) / dev
        if self.kind == "quantile":
            q = self.parameters[column]
            marks = F.array(*map(F.lit, q))
            below = F.size(F.filter(marks, lambda m: m <= x))
            a, b = F.get(marks, below - 1), F.get(marks, below)
            inside = (below - 1 + F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0))) / (len(q) - 1)
            return F.when(x.isNull(), None).when(below == 0, 0.0).when(below >= len(q), 1.0).otherwise(inside)
        shift, scale = self.parameters[column]
        return (x - shift) / scale

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})


def vector_width(df: DataFrame, column: str) -> int:
    """The one width of all vectors; ValueError if they differ."""
    row = df.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if row["a"] != row["b"]:
        raise ValueError(f"{column} has vectors of {row['a']} to {row['b']} numbers")
    return row["a"]


__all__ = ["SCALERS", "Numerical", "Embedding", "Categorical", "FeatureSet", "InputConfig", "needed_columns", "dictionary", "low_cardinality", "encode_categories", "one_hot", "Scaler", "vector_width"]
