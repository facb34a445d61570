"""Positions of regular-expression matches with built-in functions only.

``regexp_extract_all`` has the matches, ``split`` the text between them; running sums of both
lengths are the positions in code points. The sums are taken in blocks, so that a text with very
many matches costs n * BLOCK steps instead of n * n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm._columns import free

BLOCK = 256
NONE = "cast(array() as array<struct<kind:string,rank:int,start:long,end:long,score:double>>)"


def quoted(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "r'" + pattern + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def add_spans(df: DataFrame, out: str, text: str, kind: str, rank: int, pattern: str, valid: str = "true", gate: Column | None = None, group: int | None = None, score: float = 1.0) -> DataFrame:
    """``df`` with column ``out``: array<struct<kind, rank, start, end, score>> of the valid matches, in order.

    ``valid``: SQL over ``x``, the match, and ``g``, its group number ``group``. Where ``gate`` is
    false the text isn't searched. No match or a null text: an empty array.
    """
    q, column = quoted(pattern), F.col(text)
    text = f"`{text}`"
    search = F.expr(f"regexp_extract_all({text}, {q}, 0)")
    pick = F.expr(f"regexp_extract_all({text}, {q}, {group})") if group else search
    none = F.expr("cast(array() as array<string>)")
    on = column.isNotNull() if gate is None else column.isNotNull() & gate
    m, g, v, z, c = free(df, *(f"_{n}_{out}" for n in "mgvzc"))
    picked = g
    df = df.withColumn(m, F.when(on, search).otherwise(none))
    if group:
        df = df.withColumn(g, F.when(F.size(m) > 0, pick).otherwise(none))
    else:
        g = m
    df = df.withColumn(v, F.expr(f"zip_with({m}, {g}, (x, g) -> struct(length(x) as l, {valid} as ok))"))
    df = df.withColumn(
        z,
        F.expr(f"case when exists({v}, y -> y.ok) then zip_with(slice(split({text}, {q}, -1), 1, size({v})), {v}, (p, y) -> struct(cast(length(p) as bigint) as p, y.l as l, y.ok as ok)) end"),
    )
    df = df.withColumn(
        c,
        F.expr(f"transform(sequence(0, cast((size({z}) - 1) div {BLOCK} as int)), b -> aggregate(slice({z}, b * {BLOCK} + 1, {BLOCK}), 0L, (s, y) -> s + y.p + y.l))"),
    )
    whole = f"aggregate(slice({c}, 1, cast(i div {BLOCK} as int)), 0L, (s, y) -> s + y)"
    part = f"aggregate(slice({z}, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK}), 0L, (s, y) -> s + y.p + y.l)"
    df = df.withColumn(
        out,
        F.expr(
            f"case when {z} is null or size({c}) = 0 then {NONE} else transform(filter(transform({z}, (y, i) -> struct(case when y.ok then {whole} + {part} + y.p end as a, y.l as l)), y -> y.a is not null),"
            f" y -> struct('{kind}' as kind, {rank} as rank, y.a as start, y.a + y.l as end, {score}D as score)) end"
        ),
    )
    return df.drop(m, picked, v, z, c)


def ordered(columns: list[str]) -> Column:
    """All spans by start, then rank."""
    return F.expr(f"array_sort(concat({', '.join(columns)}), (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 when a.rank < b.rank then -1 when a.rank > b.rank then 1 else 0 end)")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, y -> concat_ws(':', y.kind, y.start, y.end)), ',')")
