"""Working and added columns beside a user's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def others(columns: list[str], *added: str) -> list[str]:
    """The columns that aren't named as one of ``added``, in any case of letters."""
    names = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in names]
