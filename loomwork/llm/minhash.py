"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: rounds of hashed bin placement. In each of the first COORDS rounds every shingle falls into
one random bin with a random value; in the next COORDS rounds all fall into the round's own bin.
A bin keeps its least (round, value), so every bin is filled and a document stops as soon as all
are. Coordinates agree with probability equal to the Jaccard similarity, concentrated as if drawn
independently.

1. One Arrow pass: number of shingles, a 128-bit key of the shingle set, 16 bits a coordinate.
2. Equal sets are one class: a pre-aggregated group-by. All else is on classes.
3. Classes that agree on a band of ROWS coordinates share a bucket. Every member is paired with the
   bucket's least class only (a star), never with all others.
4. Pairs are verified on full shingle sets, made anew from the texts of the classes in some pair. A text goes to each
   (centre, group) that asks for it; a centre's members are cut into groups of about GROUP, and a centre's
   set is made once a group, so a centre of a million members is neither one task nor a million copies of its text.
5. Components of the verified links: alternating large-star and small-star rounds on written tables.
6. Members other than the star's centre that are still in different components are compared too, so that a link
   which a star can't see isn't lost. Sketches are compared in blocks of about BLOCK members, which emits no pairs but, for each
   member, its QUOTA best matches of other components, each pair in the first band that it shares; over all blocks a member keeps
   QUOTA, so at most QUOTA pairs a member are verified. Links merge components, which makes most other pairs pointless.
7. Only buckets in which some member had more matches go on, with those members that had a match. There all pairs of different
   components are compared on full sets, without a quota: nothing is capped. Members outside the bucket's largest component
   are held in blocks of about HELD, the bucket's other members go past each block in slices of about HELD * GROWTH. So texts are moved once a
   block, not once a pair, and only links that join components come out. Links inside one component would change nothing.

A pair goes unseen only if no band agrees, at similarity 0.8 with probability (1 - 0.8**4)**32 =
5e-8, or if its sketches agree on less than LEAST of the coordinates, at 0.8 about 1e-8.

Null and empty texts have an empty set and are linked with nothing. Fewer words than a shingle: the
whole sequence is one shingle. Repeated rows are each returned. Rows without an id are grouped as
others; a component's id is its least id, null if it has none, and a null id is never kept unless
the text has no words. ``near_duplicates`` returns no other columns of the input; ``deduplicate`` returns all as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm._columns import free
from loomwork.llm._store import drop, later, lean, small_batches, written
from loomwork.llm._words import SPACED, Words, chunks, mix
from loomwork.llm.urlfilter import _passes, build_filter

COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
BLOCK = 2048
GROUP = 1024
QUOTA = GROWTH = 16
HELD = 512
LEAST = 0.6
_U = np.uint64
_SEEDS = np.random.default_rng(8).integers(1, 2**63, 2 * COORDS, dtype=np.uint64)
_FULL = _U(2**64 - 1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(data, off, SPACED)
    h, first, count = words.hashes(), words.first.tolist(), words.count.tolist()
    n = len(h) - k + 1
    s = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        s = s * _U(0x9E3779B97F4A7C15) + h[j : j + n]
    s = mix(s)
    out = []
    for d, c in enumerate(count):
        if c >= k:
            out.append(np.unique(s[first[d] : first[d] + c - k + 1]))
            continue
        one = _U(c)
        for x in h[first[d] : first[d] + c]:
            one = mix(np.array([one], np.uint64) + x)[0]
        out.append(np.array([one] if c else [], np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, COORDS) of 16-bit coordinates; rows of empty sets mean nothing."""
    size = np.array([len(x) for x in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), size)
    best = np.full(len(sets) * COORDS, _FULL)
    for i in range(2 * COORDS):
        if not len(h):
            break
        r = mix(h ^ _SEEDS[i])
        at = doc * COORDS + ((r & _U(COORDS - 1)).astype(np.int64) if i < COORDS else i - COORDS)
        np.minimum.at(best, at, _U(i << 56) | r >> _U(8))
        live = np.zeros(len(sets), bool)
        live[doc] = True
        rows = np.flatnonzero(live)
        live[rows] = (best.reshape(-1, COORDS)[rows] == _FULL).any(axis=1)
        keep = live[doc]
        h, doc = h[keep], doc[keep]
    return (mix(best) >> _U(48)).astype(">u2").reshape(-1, COORDS)


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in chunks(batch, "text"):
            sets = shingle_sets(data, off, k)
            rows = sketches(sets)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            flat = [rows[i].tobytes() if len(s) else None for i, s in enumerate(sets)]
            part = batch.slice(a, b - a)
            yield pa.record_batch(
                [part.column("id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(flat, pa.binary())],
                ["id", "row", "n", "node", "sketch"],
            )


def _exact(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) with 100 * intersection >= percent * union. Rows (a, g, member, b, text) are sorted; the first of each
    (a, g) is a itself."""
    centre, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for first, end, data, off in chunks(batch, "text"):
            part, keep = batch.slice(first, end - first), []
            for a, g, member, x in zip(*(part.column(c).to_pylist() for c in ("a", "g", "member")), shingle_sets(data, off, k)):
                if not member:
                    centre, own = (a, g), x
                    keep.append(False)
                    continue
                if centre != (a, g):
                    raise ValueError("a member without its centre")
                both = np.sort(np.concatenate([x, own]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _agreement(least: float):
    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(s), ">u2").reshape(-1, COORDS) for s in (x, y))
        return pd.Series((a == b).sum(axis=1) >= least * COORDS)

    return agree


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> tuple[DataFrame, str]:
    """The true links among distinct ``pairs`` (a, b), written."""
    spark = docs.sparkSession
    side = classes.select(F.col("node"), "n", "sketch")
    near = (
        pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .where(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
        .where(_agreement(LEAST)("sa", "sb"))
        .select("a", "b")
    )
    near, near_path = written(near, "near")
    most = near.groupBy("a").count().agg(F.max("count")).first()[0] or 0
    asked = near.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(-(-most // GROUP) or 1)))
    asks = F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "g", F.lit(False).alias("member")), F.struct(F.col("b").alias("node"), "a", "g", F.lit(True).alias("member"))))
    full, asked_path = _texts(docs, classes, asked.select(asks.alias("x")).select("x.*").distinct())
    full = full.select("a", "g", "member", F.col("node").alias("b"), "text")
    runs = full.repartition("a", "g").sortWithinPartitions("a", "g", "member", "b")
    links = runs.mapInArrow(lean(lambda it: _exact(it, k, percent)), "a binary, b binary").distinct()
    out = written(links, "links")
    drop(spark, near_path, asked_path)
    return out


def connected(links: DataFrame, u: str = "a", v: str = "b") -> tuple[DataFrame, str]:
    """(node, label): the least node of its component for every node in some link; written."""
    spark = links.sparkSession

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        return r[0], r[1]

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges, path = written(oriented(links.select(F.col(u).alias("u"), F.col(v).alias("v"))), "edges")
    seen = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, middle = written(oriented(large), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after, new = written(oriented(small), "small")
        drop(spark, path, middle)
        edges, path, before, seen = after, new, seen, state(after)
        if before == seen:
            break
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out = written(labels, "labels")
    drop(spark, path)
    return out


def _across(batches: Iterator[pa.RecordBatch], percent: int, quota: int) -> Iterator[pa.RecordBatch]:
    """For each member, its ``quota`` best matches (x, y, agreement) of other labels in each run of rows with one (bucket, i, j);
    a row with null x and y if there were more. The last byte of a bucket is its band; matches that share an earlier one are left
    to that one's bucket."""
    held: pa.Table | None = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_pylist()
        label = np.unique(np.array(t.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        n, own = t.column("n").to_numpy(), t.column("own").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), ">u2").reshape(-1, COORDS)
        parts = np.flatnonzero(own == i), np.flatnonzero(own == j)
        band = t.column("bucket")[0].as_py()[-1]
        before = sketch[:, : band * ROWS if band < BANDS else 0]
        before = np.ascontiguousarray(before).view(np.uint64) if before.shape[1] and len(sketch) else np.zeros((len(sketch), 0), np.uint64)  # a band of ROWS coordinates is 8 bytes
        found, more = [], False
        for left, right in [parts] if i == j else [parts, parts[::-1]]:
            for x in left.tolist():
                y = right[(label[right] != label[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
                y = y[~(before[y] == before[x]).any(axis=1)]
                same = (sketch[y] == sketch[x]).sum(axis=1)
                y, same = y[same >= LEAST * COORDS], same[same >= LEAST * COORDS]
                if len(y) > quota:
                    best = np.argsort(-same, kind="stable")[:quota]
                    y, same, more = y[best], same[best], True
                found += [(node[x], node[z], c) for z, c in zip(y.tolist(), same.tolist())]
        found += [(None, None, None)] * more
        columns = [pa.array([p[k] for p in found], pa.binary() if k < 2 else pa.int32()) for k in range(3)]
        return pa.record_batch([*columns, pa.array([t.column("bucket")[0].as_py()] * len(found), pa.binary())], ["x", "y", "same", "bucket"])

    def key(t: pa.Table) -> np.ndarray:
        k = t.column("group").to_numpy()
        return np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        ends = key(held)
        start = 0
        for e in ends[:-1].tolist():
            yield pairs(held.slice(start, e - start))
            start = e
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield pairs(held)


def _beside(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the labels of each (bucket, h, part). Rows (bucket, h, part, past, node, label, text) are sorted:
    first the texts that are held, which are compared with each other and with all that go past."""
    group, held, labels, nodes, root = None, [], [], [], {}
    code, start, owner, size = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    indexed = 0

    def find(x: bytes) -> bytes:
        while x in root:
            x = root[x]
        return x

    def index() -> None:
        nonlocal code, start, owner, size, indexed
        size, indexed = np.array([len(x) for x in held], np.int64), len(held)
        flat = np.concatenate(held)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(held)), size)[order]
        code, first = np.unique(flat[order], return_index=True)
        start = np.append(first, len(flat))

    def same(x: np.ndarray) -> np.ndarray:
        """The sizes of the intersections with the indexed sets."""
        at = np.minimum(np.searchsorted(code, x), len(code) - 1)
        at = at[code[at] == x]
        n = start[at + 1] - start[at]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - ends + n, n)
        return np.bincount(owner[places], minlength=len(size))

    def links(x: np.ndarray, node: bytes, label: bytes) -> Iterator[tuple[bytes, bytes]]:
        both = same(x)
        for z in np.flatnonzero(100 * both >= percent * (size + len(x) - both)).tolist():
            u, v = find(label), find(labels[z])
            if u != v:
                root[max(u, v)] = min(u, v)
                yield min(node, nodes[z]), max(node, nodes[z])

    def among() -> Iterator[tuple[bytes, bytes]]:
        if held and indexed < len(held):
            index()
            for x, node, label in zip(held, nodes, labels):
                yield from links(x, node, label)

    for batch in batches:
        found = []
        for first, end, data, off in chunks(batch, "text"):
            part = batch.slice(first, end - first)
            columns = (part.column(c).to_pylist() for c in ("bucket", "h", "part", "past", "node", "label"))
            for bucket, h, number, past, node, label, x in zip(*columns, shingle_sets(data, off, k)):
                if group != (bucket, h, number):
                    found += among()
                    group, held, labels, nodes, root, indexed = (bucket, h, number), [], [], [], {}, 0
                if not past:
                    held.append(x)
                    labels.append(label)
                    nodes.append(node)
                elif held:
                    found += among()
                    found += links(x, node, label)
        yield pa.record_batch([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])
    found = list(among())
    yield pa.record_batch([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])


def _texts(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``asked``, written, with the text of the class ``node``; and their path."""
    asked, path = written(asked.join(classes.select("node", F.col("rep.row").alias("_row"), F.col("rep.id").alias("_id")), "node"), "asked")
    passes = _passes(docs.sparkSession, build_filter(asked.select("_row").distinct(), "_row"))
    rows = docs.where(passes(F.xxhash64("row")))
    return rows.join(asked.hint("shuffle_hash"), (rows["row"] == asked["_row"]) & rows["id"].eqNullSafe(asked["_id"])).drop("id", "row", "_row", "_id"), path


def _settle(docs: DataFrame, classes: DataFrame, hot: DataFrame, labels: DataFrame, k: int, percent: int) -> tuple[DataFrame, str]:
    """Links (a, b) that join the components of the members (bucket, node) of each bucket, written."""
    labelled = hot.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    kinds = labelled.groupBy("bucket", "label").count()
    largest = kinds.groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    sizes = largest.select("bucket", F.col("most.label").alias("main"), F.expr(f"cast(ceil((size - most.count) / {HELD}) as int)").alias("blocks"), F.expr(f"cast(ceil(size / {HELD * GROWTH}) as int)").alias("parts"))
    rows = labelled.join(sizes, "bucket").withColumn("own", F.expr("if(label = main, blocks, cast(pmod(xxhash64(node), blocks) as int))"))
    rows = rows.withColumn("h", F.explode(F.expr("sequence(0, least(own, blocks - 1))"))).withColumn("past", F.col("h") != F.col("own"))
    rows = rows.withColumn("part", F.explode(F.expr("if(past, array(cast(pmod(xxhash64(bucket, node), parts) as int)), sequence(0, parts - 1))")))
    full, path = _texts(docs, classes, rows.select("bucket", "h", "part", "past", "node", "label"))
    key = ["bucket", "h", "part"]
    runs = full.select(*key, "past", "node", "label", "text").repartition(*key).sortWithinPartitions(*key, "past", "node")
    out = written(runs.mapInArrow(lean(lambda it: _beside(it, k, percent)), "a binary, b binary").distinct(), "settled")
    drop(docs.sparkSession, path)
    return out


def _groups(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Per row of ``docs`` (id, row, text): id, row, n, and lead, the struct (id, row) of its group's least row; null without words."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["id"].dataType.simpleString()
    meta, meta_path = written(docs.mapInArrow(lean(lambda it: _describe(it, shingle)), f"id {kind}, row long, n long, node binary, sketch binary"), "meta")
    classes, classes_path = written(
        meta.where("node is not null").groupBy("node").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("known"), F.min(F.struct("id", "row")).alias("any"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select("node", F.coalesce("known", "any").alias("rep"), "n", "sketch"),
        "classes",
    )
    bands = classes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sketch")
    bands = bands.select("node", F.expr(f"concat(substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS}), cast(char(band) as binary))").alias("bucket"))
    centres = bands.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("m")).where("m > 1")
    members, members_path = written(bands.join(centres, "bucket").where("node != centre"), "members")
    links, links_path = _verify(docs, classes, members.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), shingle, percent)
    labels, labels_path = connected(links)

    tested = members.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    labelled = members.where("m > 2").select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("size")).where("l0 != l1")
    blocks = (
        labelled.join(split.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket")
        .withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
        .join(classes.select("node", "n", "sketch"), "node")
        .withColumn("group", F.xxhash64("bucket", "i", "j"))
    )
    runs = blocks.repartition("group").sortWithinPartitions("group", "node").select("group", "i", "j", "own", "node", "label", "n", "sketch", "bucket")
    seen, seen_path = written(runs.mapInArrow(lean(lambda it, q=QUOTA: _across(it, percent, q)), "x binary, y binary, same int, bucket binary"), "seen")
    best = Window.partitionBy("x").orderBy(F.desc("same"), "y")
    top = seen.where("x is not null").groupBy("x", "y").agg(F.max("same").alias("same")).withColumn("r", F.row_number().over(best)).withColumn("more", F.max("r").over(Window.partitionBy("x")) > QUOTA)
    top, top_path = written(top, "top")
    new = top.where(F.col("r") <= QUOTA).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    new, new_path = written(new, "new")
    paths = [seen_path, top_path, new_path]

    def further(extra: DataFrame, path: str) -> None:
        nonlocal links, labels, labels_path
        paths.append(path)
        if not extra.isEmpty():
            links = links.union(extra)
            drop(spark, labels_path)
            labels, labels_path = connected(links)

    if not new.isEmpty():
        further(*_verify(docs, classes, new, shingle, percent))
    cut = seen.where("x is null").select("bucket").union(seen.join(top.where("more").select("x").distinct(), "x", "left_semi").select("bucket")).distinct()
    cut, cut_path = written(cut, "cut")
    paths.append(cut_path)
    if not cut.isEmpty():
        hot = seen.where("x is not null").select("bucket", F.col("x").alias("node")).distinct().join(cut, "bucket", "left_semi")
        further(*_settle(docs, classes, hot, labels, shingle, percent))
    drop(spark, members_path, links_path, *paths)
    later(meta_path, classes_path, labels_path)

    grouped = classes.select("node", "rep").join(labels, "node")
    least = grouped.groupBy("label").agg(F.min(F.when(F.col("rep.id").isNotNull(), F.col("rep"))).alias("known"), F.min("rep").alias("any"))
    moved = grouped.join(least, "label").select("node", F.coalesce("known", "any").alias("least"))
    final = classes.select("node", "rep").join(moved, "node", "left").select("node", F.coalesce("least", "rep").alias("lead"))
    return meta.select("id", "row", "n", "node").join(final, "node", "left").select("id", "row", "n", "lead")


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))


def _checked(percent: int) -> None:
    if not 80 <= percent <= 100:
        raise ValueError(f"similarity of {percent} %: the bands are made for 80 or more")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id (least id of its group) and kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Two documents are linked if
    100 * intersection >= ``percent`` * union of their sets of ``shingle``-word shingles; ValueError under 80, for
    which the bands are made.
    """
    _checked(percent)
    found = _groups(_keyed(docs, id, text), shingle, percent)
    component = F.when(F.col("lead").isNull(), F.col("id")).otherwise(F.col("lead.id"))
    kept = F.when(F.col("lead").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("lead.id"), F.lit(False)))
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: the least id's; of rows equal in id and text one. Texts without words all stay."""
    _checked(percent)
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = _groups(_keyed(docs.where(worded), id, text), shingle, percent)
    key, row, own = free(docs, "_key", "_row", "_id")
    leads = found.where("row = lead.row and id <=> lead.id").select(F.col("row").alias(row), F.col("id").alias(own)).distinct()
    rows = docs.where(worded).withColumn(key, F.xxhash64(id, text))
    lead = rows.join(leads, (F.col(key) == F.col(row)) & F.col(id).eqNullSafe(F.col(own)), "left_semi").dropDuplicates([key, id])
    return lead.select(*docs.columns).unionByName(docs.where(~worded))
