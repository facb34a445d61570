"""Benchmark decontamination with suffix arrays of the training text.

Each chunk of documents is one shard. Its words become numbers of the test vocabulary; stretches of words that a test
text could hold (all words and all pairs of neighbours occur there, and the stretch is as long as the shortest
window) are kept, all others can match nothing. The suffixes of these stretches are sorted at full depth, by
prefix doubling: the shard's suffix array. Every test suffix is binary-searched in it by its window, its first
``window`` words, which gives its occurrences. The longest verbatim match at an occurrence is found from the other
side: the occurrence's suffix is binary-searched in the suffix array of the test texts, and its neighbours there have the
longest common prefix with it. One Arrow pass over the documents; no shuffle.

The test side is broadcast while its texts are at most ``max_broadcast`` bytes; beyond that it is cut into slices of
about that size, which tasks build and write to the shared folder. A task then holds HOLD bytes of documents and runs
through the slices once for all of them. A window that many items share has one list of items, which is looked
at once a document, whatever the number of hits.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; equal 64-bit hashes count as
equal words. Nulls and texts without words have no words and no hits. Items without words match
nothing. Item rows of one id count once; a null id reads ``null`` and is an item of its own. Repeated documents are all
kept. ``find_overlaps`` replaces columns that are named as added ones, in any case of letters; ``decontaminate`` changes none.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm._columns import others
from loomwork.llm._store import direct, later, lean, new_path, opened, put, small_batches
from loomwork.llm._words import ALNUM, Words, chunks, mix

ADDED = ("n_words", "n_hit", "items", "longest_words", "longest_at", "longest_item")
#: Bytes of documents that a task holds while it runs through several slices.
HOLD = 32_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class TestSide:
    """Some items. ``vocab``: sorted word hashes; word id = place + 1. Windows are distinct; ``lists`` of items too."""

    vocab: np.ndarray
    pairs: np.ndarray
    least: int
    width: int
    window: int
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    #: suffixes of the suffix array that start with the window
    begin: np.ndarray
    end: np.ndarray
    list_of: np.ndarray
    cut: np.ndarray
    item: np.ndarray
    #: all test words with a 0 after each text, the suffix array of them, and the item at each place
    word: np.ndarray
    order: np.ndarray
    owner: np.ndarray
    ids: list[str]


def suffix_array(word: np.ndarray) -> np.ndarray:
    """Places of the words above 0, sorted by the suffixes up to the next 0, at full depth; equal ones by place."""
    alive, room = np.flatnonzero(word), _room(word)
    rank, step = word.astype(np.int64), 1
    while len(alive):  # ranks are of ``step`` words
        goes = room[alive] > step
        beyond = np.zeros(len(alive), np.int64)
        beyond[goes] = rank[alive[goes] + step]
        distinct, inverse = np.unique(rank[alive] * (int(rank.max()) + 1) + beyond, return_inverse=True)
        rank[alive] = inverse + 1
        step *= 2
        if len(distinct) == len(alive) or not goes.any():
            break
    return alive[np.argsort(rank[alive], kind="stable")]


def _room(word: np.ndarray) -> np.ndarray:
    """Words from each place to the next 0."""
    stop = np.append(np.flatnonzero(word == 0), len(word))
    place = np.arange(len(word))
    return stop[np.searchsorted(stop, place)] - place


class Prefixes:
    """Hashes of all stretches of a sequence of words, from sums over its beginnings."""

    def __init__(self, word: np.ndarray):
        power = np.full(len(word) + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        self.sum = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(mix(word.astype(np.uint64) + _U(77)) * self.power[:-1], out=self.sum[1:])
        self.room = _room(word)

    def of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.sum[at + n] - self.sum[at]


def common(x: Prefixes, p: np.ndarray, y: Prefixes, q: np.ndarray) -> np.ndarray:
    """Words that the suffixes at p of x and q of y have in common."""
    most = np.minimum(x.room[p], y.room[q])
    n = np.zeros(len(p), np.int64)
    step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
    while step:
        more = n + step
        fits = np.flatnonzero(more <= most)
        same = x.of(p[fits], more[fits]) * y.power[q[fits]] == y.of(q[fits], more[fits]) * x.power[p[fits]]
        n[fits[same]] += step
        step >>= 1
    return n


def _encode(rows: np.ndarray, width: int) -> np.ndarray:
    """Byte strings that sort as the rows of word ids."""
    flat = np.ascontiguousarray(rows.astype(f">u{width}"))
    return flat.view(f"S{width * rows.shape[1]}").ravel()


def _rows(word: np.ndarray, place: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """The first ``length`` words at each place, then zeros."""
    step = np.arange(window)
    rows = word[np.minimum(place[:, None] + step, len(word) - 1)]
    rows[step >= length[:, None]] = 0
    return rows


def build_test_side(ids: list[str | None], texts: list[str], window: int) -> TestSide:
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), off, ALNUM)
    vocab, number = np.unique(words.hashes(), return_inverse=True)
    names = sorted(dict.fromkeys(ids), key=lambda x: (x is not None, x or ""))
    name = {x: i for i, x in enumerate(names)}
    width = 2 if len(vocab) < 65_000 else 4
    # all words, a 0 after each text
    place = np.arange(len(number)) + words.doc
    word = np.zeros(len(number) + len(raw), np.int32)
    word[place] = number + 1
    owner = np.zeros(len(word), np.int32)
    owner[place] = np.array([name[x] for x in ids], np.int32)[words.doc] if len(number) else 0
    left = words.first[1:][words.doc] - np.arange(len(number))
    whole = np.minimum(words.count, window)[words.doc]
    starts = left >= whole
    at, length = place[starts], whole[starts].astype(np.int32)
    rows = _rows(word, at, length, window)
    low, first, group = np.unique(_encode(rows, width), return_index=True, return_inverse=True)
    high = rows[first]
    n = length[first]
    high[np.arange(len(high)), n - 1] += 1
    high = _encode(high, width)
    # the items of each window, and the distinct lists of them
    pair = np.unique(group.astype(np.int64) * len(names) + owner[at]) if len(at) else np.zeros(0, np.int64)
    cuts = np.searchsorted(pair, np.arange(len(low) + 1) * max(len(names), 1))
    item = pair % max(len(names), 1)
    seen: dict[bytes, int] = {}
    list_of = np.zeros(len(low), np.int64)
    parts = []
    for w in range(len(low)):
        part = item[cuts[w] : cuts[w + 1]]
        k = seen.setdefault(part.tobytes(), len(seen))
        list_of[w] = k
        if k == len(parts):
            parts.append(part)
    order = suffix_array(word)
    heads = _encode(_rows(word, order, np.minimum(_room(word)[order], window), window), width)
    adjacent = (word[:-1] > 0) & (word[1:] > 0)
    pairs = np.unique(word[:-1][adjacent].astype(np.int64) * (len(vocab) + 1) + word[1:][adjacent])
    return TestSide(
        vocab, pairs, int(n.min()) if len(n) else 1, width, window, low, high, n, np.searchsorted(heads, low), np.searchsorted(heads, high), list_of,
        np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int64), word, order, owner,
        ["null" if x is None else x for x in names],
    )


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, member) of all members of the ranges."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Shard:
    """The stretches of a shard that could match, as words with a 0 after each, and their suffix array."""

    def __init__(self, h: np.ndarray, first: np.ndarray, side: TestSide):
        self.word = np.zeros(0, np.int32)
        if not len(h) or not len(side.low):
            return
        place = np.minimum(np.searchsorted(side.vocab, h), len(side.vocab) - 1)
        word = np.where(side.vocab[place] == h, place + 1, 0).astype(np.int32)
        key = word[:-1].astype(np.int64) * (len(side.vocab) + 1) + word[1:]
        goes = (word[:-1] > 0) & (word[1:] > 0)
        maybe = np.flatnonzero(goes)
        goes[maybe] = side.pairs[np.minimum(np.searchsorted(side.pairs, key[maybe]), len(side.pairs) - 1)] == key[maybe] if len(side.pairs) else False
        edge = first[(first > 0) & (first < len(h))]
        goes[edge - 1] = False
        start = np.flatnonzero((word > 0) & np.append(True, ~goes))
        stop = np.flatnonzero((word > 0) & np.append(~goes, True)) + 1
        long = stop - start >= side.least
        start, stop = start[long], stop[long]
        if not len(start):
            return
        which, source = _spread(start, stop)
        at = np.arange(len(source)) + which
        self.word = np.zeros(len(source) + len(start), np.int32)
        self.word[at] = word[source]
        self.source = np.zeros(len(self.word), np.int64)
        self.source[at] = source
        self.order = suffix_array(self.word)


def search(h: np.ndarray, first: np.ndarray, side: TestSide) -> tuple[np.ndarray, np.ndarray, Shard, np.ndarray]:
    """(word position, window number) of all occurrences in a shard of words with hashes ``h``, the shard, and the
    positions in it."""
    shard = Shard(h, first, side)
    nothing = np.zeros(0, np.int64)
    if not len(shard.word):
        return nothing, nothing, shard, nothing
    room = np.minimum(_room(shard.word)[shard.order], side.window)
    keys = _encode(_rows(shard.word, shard.order, room, side.window), side.width)
    lo, hi = np.searchsorted(keys, side.low), np.searchsorted(keys, side.high)
    window, member = _spread(lo, np.maximum(lo, hi))
    inside = shard.order[member]
    return shard.source[inside], window, shard, inside


def _longest(shard: Shard, inside: np.ndarray, w: np.ndarray, side: TestSide) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard, words, item) of the longest match at each place of a hit, from the neighbours of its suffix in the
    suffix array of the test texts."""
    by = np.lexsort((-side.length[w], inside))
    inside, w = inside[by], w[by]
    new = np.append(True, inside[1:] != inside[:-1])
    p, w = inside[new], w[new]
    x, y = Prefixes(shard.word), Prefixes(side.word)
    lo, hi = side.begin[w].copy(), side.end[w].copy()
    while True:
        open = np.flatnonzero(lo < hi)
        if not len(open):
            break
        mid = (lo[open] + hi[open]) // 2
        q = side.order[mid]
        n = common(x, p[open], y, q)
        less = side.word[q + n] < shard.word[p[open] + n]  # a text that ends has a 0 there
        lo[open] = np.where(less, mid + 1, lo[open])
        hi[open] = np.where(less, hi[open], mid)
    left, right = np.maximum(lo - 1, side.begin[w]), np.minimum(lo, side.end[w] - 1)
    a, b = (common(x, p, y, side.order[k]) for k in (left, right))
    best = np.where(a >= b, left, right)
    return p, np.maximum(a, b), side.owner[side.order[best]]


class _Chunk:
    """What is known of some documents so far."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        words = Words(data, off, ALNUM)
        self.h, self.doc, self.first, self.count = words.hashes(), words.doc, words.first, words.count
        self.edge = np.zeros(len(self.h) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in self.count]
        self.best: list[tuple] = [(0, None, None)] * len(self.count)

    def meet(self, side: TestSide, whole: bool) -> None:
        p, w, shard, inside = search(self.h, self.first, side)
        if not len(p):
            return
        np.add.at(self.edge, p, 1)
        np.add.at(self.edge, p + side.length[w], -1)
        if not whole:
            return
        lists = np.unique(self.doc[p] * len(side.cut) + side.list_of[w])
        doc, k = lists // len(side.cut), lists % len(side.cut)
        which, member = _spread(side.cut[k], side.cut[k + 1])
        for d, i in zip(*np.divmod(np.unique(doc[which] * len(side.ids) + side.item[member]), len(side.ids))):
            self.items[d].add((side.ids[i], i))
        place, n, item = _longest(shard, inside, w, side)
        at = shard.source[place]
        by = np.lexsort((item, at, -n, self.doc[at]))
        by = by[np.append(True, self.doc[at[by]][1:] != self.doc[at[by]][:-1])]
        for d, length, a, i in zip(self.doc[at[by]].tolist(), n[by].tolist(), at[by].tolist(), item[by].tolist()):
            found = (length, a - int(self.first[d]), side.ids[i])
            if (-found[0], *found[1:]) < (-self.best[d][0], self.best[d][1] or 0, self.best[d][2] or ""):
                self.best[d] = found

    def hits(self) -> np.ndarray:
        return np.bincount(self.doc[np.cumsum(self.edge[:-1]) > 0], minlength=len(self.count))


def _run(batches: Iterator[pa.RecordBatch], sides: list, kept: list[str], text: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """Documents with what was found; without ``whole``, those without hits."""
    held: list[tuple[pa.RecordBatch, _Chunk]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for side in map(_load, sides):
            for _, chunk in held:
                chunk.meet(side, whole)
        for part, c in held:
            hit = c.hits()
            if not whole:
                yield part.filter(pa.array(hit == 0))
                continue
            added = (
                pa.array(c.count, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x for x, _ in s) for s in c.items], pa.list_(pa.string())),
                *(pa.array([x[k] for x in c.best], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))),
            )
            yield pa.record_batch([*(part.column(x) for x in kept), *added], [*kept, *ADDED])

    for batch in batches:
        for a, b, data, off in chunks(batch, text):
            held.append((batch.slice(a, b - a), _Chunk(data, off)))
            size += len(data)
            if len(sides) == 1 or size >= HOLD:
                yield from flush()
                held, size = [], 0
    yield from flush() if held else ()


def _load(source) -> TestSide:
    if isinstance(source, str):
        where, path = opened(source)
        with where.open_input_stream(path) as f:
            return pickle.loads(f.read())
    return source.value


def _sides(benchmark: DataFrame, window: int, max_broadcast: int) -> list:
    """The test side as one broadcast value, or as the paths of slices."""
    spark = benchmark.sparkSession
    tests = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // max_broadcast) or 1
    if n == 1:
        rows = tests.collect()  # at most max_broadcast bytes of texts
        return [spark.sparkContext.broadcast(build_test_side([r.id for r in rows], [r.text for r in rows], window))]
    direct(spark)
    folder = new_path(spark, "tests")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_of, ids, texts = None, [], []

        def made() -> pa.RecordBatch:
            side, name = build_test_side(ids, texts, window), uuid.uuid4().hex
            put(folder, name, lambda f: f.write(pickle.dumps(side)))
            return pa.record_batch([pa.array([f"{folder}/{name}"])], ["path"])

        for batch in batches:
            for k, i, t in zip(*(batch.column(c).to_pylist() for c in ("slice", "id", "text"))):
                if ids and k != slice_of:
                    yield made()
                    ids, texts = [], []
                slice_of = k
                ids.append(i)
                texts.append(t)
        if ids:
            yield made()

    parts = tests.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(n))).repartition(n, "slice").sortWithinPartitions("slice")
    later(folder)
    return [r.path for r in parts.mapInArrow(lean(build), "path string").collect()]  # a path a slice


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, max_broadcast: int = 4_000_000, text: str = "text") -> DataFrame:
    """``docs`` (with ``text``) and, for each: n_words, n_hit, items (sorted ids of items with occurring
    windows), longest_words, longest_at (word number), longest_item (an item that has it). ``benchmark``: item_id, text.

    ``keep``: the input columns to return, all by default; columns named as added ones are replaced.
    """
    small_batches(docs.sparkSession)
    kept = others(keep or docs.columns, *ADDED)
    sides = _sides(benchmark, window, max_broadcast)
    source = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([source.schema[c] for c in kept])
    for name, kind in zip(ADDED, (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.LongType(), T.LongType(), T.StringType())):
        schema = schema.add(name, kind)
    return source.mapInArrow(lean(lambda it: _run(it, sides, kept, text, True)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_broadcast: int = 4_000_000, text: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns as they are."""
    small_batches(docs.sparkSession)
    sides = _sides(benchmark, window, max_broadcast)
    return docs.mapInArrow(lean(lambda it: _run(it, sides, [], text, False)), docs.schema)
