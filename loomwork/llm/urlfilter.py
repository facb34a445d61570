"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The Bloom filter of the list has 512-bit blocks; one hash picks a block and one bit in each of its
eight words. It is built by a grouped bit_or and never exceeds ``max_bytes``: a longer list only
raises the share of false positives. The distinct keys that pass, counted, meet the list in an exact hash
join: keys only, and only those that the filter lets through, are shuffled. What is confirmed goes back to the pages by
broadcast while it is at most ``broadcast_bytes``. Beyond that, keys with a ten-thousandth of all passing rows or more
(at most 10,000 keys, by arithmetic), listed or not, are still broadcast, and only the rows that pass with other keys
are shuffled, so that no key is hot.

A null url, or one without ``://``, has empty host and path, fits no rule and isn't listed.
Repeated rows are each returned. Columns that clash with the added ones, in any case of letters, are replaced; others
stay as they are. An empty list blocks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm._columns import free, others
from loomwork.llm._store import drop, later, lean, written

ADDED = ("host", "path", "canonical", "rule", "listed", "verdict")
BROADCAST_BYTES = 16 << 20
HOT_KEYS = 10_000
_ODD = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?`` or ``#``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(host: Column, path: Column) -> Column:
    """Scheme, www., query, fragment, a final slash, index pages and .html don't distinguish URLs."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/index)?(\.html?)?/*$", ""))


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the eight masks of each hash."""
    u = h.astype(np.int64).view(np.uint64)
    block = ((u >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    low = u & np.uint64(0xFFFFFFFF)
    return block, np.uint64(1) << (((low[:, None] * _ODD) & np.uint64(0xFFFFFFFF)) >> np.uint64(26))


def build_filter(listed: DataFrame, key: str, max_bytes: int = 32 << 20) -> np.ndarray:
    """The filter as an array (blocks, 8) of 64-bit words, 16 bits a key and at most ``max_bytes``."""
    n = listed.count()
    blocks = max(1, min(-(-n * 16 // 512), max_bytes // 64))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            block, mask = _bits(batch.column(0).to_numpy(), blocks)
            yield pa.record_batch([pa.array(block), *(pa.array(mask[:, i].view(np.int64)) for i in range(8))], ["block", *(f"w{i}" for i in range(8))])

    rows = listed.select(F.xxhash64(key)).mapInArrow(lean(run), "block long, " + ", ".join(f"w{i} long" for i in range(8)))
    made = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toPandas()  # at most max_bytes
    out = np.zeros((blocks, 8), np.uint64)
    for i in range(8):
        out[made["block"].to_numpy(), i] = made[f"w{i}"].to_numpy().view(np.uint64) if len(made) else 0
    return out


def _passes(spark, table: np.ndarray):
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        block, mask = _bits(h.to_numpy(), len(sent.value))
        return pd.Series(((sent.value[block] & mask) == mask).all(axis=1))

    return passes


def confirmed(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, n, listed): the rows of ``keys`` (key, null where the filter stops it) by key, and whether the list has it."""
    counts = keys.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return counts.join(listed.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judge(pages: DataFrame, rules: tuple[Rule, ...], listed: DataFrame, url: str = "url", max_bytes: int = 32 << 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, canonical, rule, listed and verdict. ``listed``: column ``url`` of canonical URLs
    (``host/path``; a bare host lists the whole host). The longest fitting rule decides, else the list: block if listed."""
    base = pages.select(*others(pages.columns, *ADDED))
    keys, keys_path = written(listed.select(F.col("url").alias("key")).where("key is not null and key != ''").distinct(), "list")
    passes = _passes(pages.sparkSession, build_filter(keys, "key", max_bytes))

    def parts(address: Column) -> tuple[Column, Column, Column]:
        host, path = host_and_path(address)
        host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
        return host, path, canonical(host, path)

    def through(key: Column) -> Column:
        return F.when(passes(F.xxhash64(key)) & (key != ""), key)

    whole = lambda canon: F.split_part(canon, F.lit("/"), F.lit(1))
    canon = pages.select(parts(F.col(url))[2].alias("c")).select("c", whole(F.col("c")).alias("w"))
    asked = canon.select(F.explode(F.array(through(F.col("c")), F.when(F.col("c") != F.col("w"), through(F.col("w"))))).alias("key"))
    found, path = written(confirmed(asked, keys), "listed")
    drop(pages.sparkSession, keys_path)
    later(path)

    k0, k1, ruled = free(base, "_canonical_key", "_host_key", "_ruled")
    host, path, made = parts(F.col(url))
    out = base.withColumns({"host": host, "path": path, "canonical": made})
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    out = out.withColumns({"rule": rule, ruled: verdict, k0: F.col("canonical"), k1: whole(F.col("canonical"))})
    size = found.agg(F.sum(F.when(F.col("listed"), F.octet_length("key") + 32)), F.sum("n")).first()
    if (size[0] or 0) <= broadcast_bytes:
        out = _marked(out, F.broadcast(found.where("listed")), k0, k1)
        out = out.withColumn("listed", F.coalesce(*_marks(k0, k1), F.lit(False))).drop(*_marks(k0, k1))
    else:
        out = _marked(out, F.broadcast(found.where(F.col("n") * HOT_KEYS >= size[1])), k0, k1)  # at most HOT_KEYS rows
        m0, m1 = _marks(k0, k1)
        out = out.withColumns({k0: F.when(F.col(m0).isNull(), through(F.col(k0))), k1: F.when(F.col(m1).isNull(), through(F.col(k1)))})
        out = out.withColumn("listed", F.coalesce(m0, F.lit(False)) | F.coalesce(m1, F.lit(False))).drop(m0, m1)
        stays = F.col("listed") | (F.col(k0).isNull() & F.col(k1).isNull())
        rest = _marked(out.where(~stays).drop("listed"), found.where(F.col("n") * HOT_KEYS < size[1]).hint("shuffle_hash"), k0, k1)
        rest = rest.withColumn("listed", F.coalesce(m0, F.lit(False)) | F.coalesce(m1, F.lit(False))).drop(m0, m1)
        out = out.where(stays).unionByName(rest)
    out = out.withColumn("verdict", F.coalesce(ruled, F.when(F.col("listed"), "block").otherwise("allow")))
    return out.select(*base.columns, *ADDED)


def _marks(k0: str, k1: str) -> tuple[str, str]:
    return k0 + "_listed", k1 + "_listed"


def _marked(rows: DataFrame, found: DataFrame, k0: str, k1: str) -> DataFrame:
    """``rows`` with a column for either key: whether ``found`` lists it, null if ``found`` doesn't have it. A row without one key goes
    by the other, so such rows don't meet in one task."""
    for key, other, mark in ((k0, k1, _marks(k0, k1)[0]), (k1, k0, _marks(k0, k1)[1])):
        side = found.select(F.col("key").alias(mark + "_key"), F.col("listed").alias(mark))
        own = F.coalesce(key, F.concat(F.lit("\x00"), F.col(other)))
        rows = rows.join(side, own == F.col(mark + "_key"), "left").drop(mark + "_key")
    return rows
