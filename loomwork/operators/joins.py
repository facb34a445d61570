"""Joins with the semantics that feature tables need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal; the keys appear once, from ``left``."""
    renamed = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*(f"_right_{k}" for k in keys))


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", unique: bool = False) -> DataFrame:
    """An equi-join; ``unique`` first keeps one right row per key, so that no left row is multiplied."""
    if how not in KINDS:
        raise ValueError(f"{how} is none of {', '.join(KINDS)}")
    return left.join(right.dropDuplicates(on) if unique else right, on, how)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Membership as a semi-join."""
    return df.join(ids.select(key), key, "left_semi")


def map_values(df: DataFrame, column: str, mapping: dict, out: str | None = None) -> DataFrame:
    """A dictionary lookup by a join with a table as small as the dictionary; other values stay null."""
    field = df.schema[column].dataType.simpleString()
    kind = "string" if any(isinstance(v, str) for v in mapping.values()) else "double" if any(isinstance(v, float) for v in mapping.values()) else "bigint"
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"_from {field}, _to {kind}")
    return df.join(F.broadcast(table), F.col(column) == F.col("_from"), "left").withColumn(out or column, F.col("_to")).drop("_from", "_to")


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that some lack are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def side_by_side(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The columns of both, row i of ``left`` beside row i of ``right`` in the orders given; the shorter one ends in nulls."""
    from loomwork.operators.folds import with_row_index

    i = free_name(left, free_name(right, "_i"))
    return with_row_index(left, left_order, i).join(with_row_index(right, right_order, i), i, "full").drop(i)


def gathered(df: DataFrame, places: DataFrame, place: str, order: list[str]) -> DataFrame:
    """``places`` with the row of ``df`` at each 0-based ``place`` in the order given; nulls where there is none. Repeated places repeat rows."""
    from loomwork.operators.folds import with_row_index

    return places.join(with_row_index(df, order, place), place, "left")
