"""n-gram language-model scores with a weighted backoff automaton.

States are the n-gram histories seen in training. A state h has an arc for each word that followed
it, with weight log10 p(w | h), and a failure arc to the state without its first word, with weight
log10(K / (c(h) + K)). The smoothing is Bayesian with a Dirichlet prior of mass K on the lower order,
p(w | h) = (c(hw) + K * p(w | h')) / (c(h) + K), down to the add-0.1 unigram model, so each state's
probabilities sum to 1 and the failure weight depends on c(h) alone.

The automaton grows with the corpus and is never held whole. Documents are cut into blocks of about
``block_bytes``; a block needs the arcs of its own n-grams only:

1. Each block writes its texts to the shared folder and sends its distinct n-grams, sorted and
   packed, with their training counts, to buckets by ranges of the hash. A frequent n-gram is one
   entry a block, so no key is hot.
2. A bucket adds the counts up and returns to each block the totals of its entries, in order.
3. Each block builds the automaton of its n-grams (states, arcs, failure arcs) and walks it over its documents
   from left to right. All texts walk side by side, a token a step, and a long text walks in stretches of
   STRETCH tokens: each starts at the root ``order - 1`` tokens early, which leads to the same state as
   the whole text before it, as a state is the longest seen history of at most ``order - 1`` words.

Block names are made of their rows, partition and number, so a recomputed block has the same name; if a source gives
other blocks when it is read again, the last step finds totals missing and fails. A block's file is written under a
name of its attempt and then renamed, so attempts that run side by side, or are killed, leave no torn file.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end. Null and empty texts are one
end. Equal hashes count as equal n-grams: of 64 bits for words, 56 for longer ones, so that of 10**13 n-grams one in
7,000 shares its count with another. Repeated rows are each counted and returned. Without
training rows every text has probability 1 per token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm._store import direct, drop, later, lean, new_path, opened, put, small_batches, written
from loomwork.llm._words import SPACED, Words, column, mix

_U = np.uint64
START, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
PRIOR = 2.0
STRETCH = 512
TASK_BYTES = 16_000_000


def _packed(values: np.ndarray) -> bytes:
    """Bytes by significance, then zstd: sorted keys and small counts shrink well."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(values).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(b[:4], "little"), np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(b[4:], n * width, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, which are shorter."""
    return _packed(np.diff(keys, prepend=keys.dtype.type(0)))


def _unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b, np.uint64), dtype=np.uint64)


def key_bits(n: int) -> int:
    return 64 if n == 1 else 56


class Grams:
    """n-grams of some texts: ``keys[n]`` sorted, ``at[n]`` the key number at each token (-1: too early in its text)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, order: int):
        words = Words(data, off, SPACED)
        count = words.count
        # a start and an end around each text's words
        size = count + 2
        begin = np.cumsum(size) - size
        seq = np.full(int(size.sum()), END)
        seq[begin] = START
        seq[np.arange(len(words.start)) + 2 * words.doc + 1] = words.hashes()
        doc = np.repeat(np.arange(len(count)), size)
        place = np.arange(len(seq)) - begin[doc]
        real = place > 0
        self.doc, self.tokens = doc[real], count + 1
        self.first = place[real] == 1
        self.keys: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        gram = seq
        for n in range(1, order + 1):
            if n > 1:
                longer = np.zeros_like(gram)
                longer[n - 1 :] = mix(gram[n - 2 : -1] * _U(0x9E3779B97F4A7C15) + seq[n - 1 :])
                gram = longer
            whole = real & (place >= n - 1)
            self.keys[n], inverse = np.unique(gram[whole] >> _U(64 - key_bits(n)), return_inverse=True)
            at = np.full(len(seq), -1)
            at[whole] = inverse
            self.at[n] = at[real]


class Automaton:
    """States, arcs and failure arcs of one block's n-grams. ``counts[n]``: training counts of ``grams.keys[n]``.

    State 0 is the root, 1 the start of a text, then come the seen histories by length. Arc a is the n-gram
    history + word: ``arc_weight[a]``, ``arc_target[a]``. ``arc_at[m, t]`` is the arc of token t from the state of the
    m words before it, -1 if there is none; the root has one for every word. State s fails to ``fail_state[s]`` with
    ``fail_weight[s]``; ``level[s]`` is its number of words.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], tokens: int, words: int, prior: float = PRIOR):
        self.grams, order = grams, max(grams.keys)
        end = np.flatnonzero(grams.keys[1] == END)
        texts = float(counts[1][end[0]]) if len(end) else 0.0
        self.unknown = 0.1 / (tokens + 0.1 * (words + 1))
        # state of each history: seen ones only, ends are none
        state, n_states = {}, 2
        token = {n: self._token(n) for n in grams.keys}
        for n in range(1, order):
            seen = (counts[n] > 0) & ~np.isin(grams.at[1][token[n]], end)
            state[n] = np.where(seen, np.cumsum(seen) - 1 + n_states, -1)
            n_states += int(seen.sum())
        self.level = np.zeros(n_states, np.int32)
        self.fail_state, self.fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states)
        self.total = np.zeros(n_states)
        self.level[1], self.total[1] = (1, texts) if order > 1 else (0, 0.0)
        for n in range(1, order):
            k = np.flatnonzero(state[n] >= 0)
            s = state[n][k]
            self.level[s], self.total[s] = n, counts[n][k]
            self.fail_state[s] = state[n - 1][grams.at[n - 1][token[n][k]]] if n > 1 else 0
        self.fail_weight[1:] = np.log10(prior / (self.total[1:] + prior))
        # arcs: those of the root for all words, then the seen longer n-grams
        self.arc_at = np.full((order, len(grams.doc)), -1, np.int64)
        weight, target, source = [], [], []
        below, n_arcs = np.zeros(0), 0
        for n in range(1, order + 1):
            seen = counts[n] > 0 if n > 1 else np.ones(len(counts[1]), bool)
            k = np.flatnonzero(seen)
            t = token[n][k]
            number = np.where(seen, np.cumsum(seen) - 1 + n_arcs, -1)
            if n == 1:
                history, p = np.zeros(len(k), np.int64), (counts[1] + 0.1) / (tokens + 0.1 * (words + 1))
            else:
                history = np.where(grams.first[t], 1, state[n - 1][grams.at[n - 1][t - 1]]) if n == 2 else state[n - 1][grams.at[n - 1][t - 1]]
                p = (counts[n][k] + prior * below[grams.at[n - 1][t]]) / (self.total[history] + prior)
            if n < order:
                to = np.maximum(state[n][k], 0)  # unknown words and ends lead to the root
            else:
                to = np.maximum(state[n - 1][grams.at[n - 1][t]], 0) if n > 1 else np.zeros(len(k), np.int64)
            weight.append(np.log10(p))
            target.append(to)
            source.append(history)
            below = np.zeros(len(counts[n]))
            below[k] = p
            there = grams.at[n] >= 0
            self.arc_at[n - 1, there] = number[grams.at[n][there]]
            n_arcs += len(k)
        self.arc_weight, self.arc_target, self.arc_source = np.concatenate(weight), np.concatenate(target), np.concatenate(source)
        self.base = self.arc_weight[: len(counts[1])]

    def _token(self, n: int) -> np.ndarray:
        """A token of the block that ends each n-gram."""
        at = self.grams.at[n]
        out = np.zeros(len(self.grams.keys[n]), np.int64)
        there = np.flatnonzero(at >= 0)
        out[at[there]] = there
        return out

    def traverse(self, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token by the base model and by the automaton: a walk from left to right."""
        g = self.grams
        early = len(self.arc_at) - 1
        out = np.zeros(len(g.doc))
        first = np.flatnonzero(g.first)
        n = -(-g.tokens // stretch)
        text = np.repeat(np.arange(len(n)), n)
        skip = (np.arange(len(text)) - (np.cumsum(n) - n)[text]) * stretch
        begin = first[text] + skip
        stop = np.minimum(begin + stretch, (first + g.tokens)[text])
        place = np.maximum(begin - early, first[text])
        state = np.where(place > first[text], 0, 1)
        order = np.argsort(place - stop, kind="stable")  # the longest first, so that those still walking are a prefix
        place, stop, begin, state = place[order], stop[order], begin[order], state[order]
        steps = stop - place
        for step in range(int(steps[0]) if len(steps) else 0):
            live = int(np.searchsorted(-steps, -step, "left"))
            t, s = place[:live] + step, state[:live]
            lost = np.zeros(live)
            arc = self.arc_at[self.level[s], t]
            fails = np.flatnonzero(arc < 0)
            while len(fails):
                at = s[fails]
                lost[fails] += self.fail_weight[at]
                s[fails] = self.fail_state[at]
                arc[fails] = self.arc_at[self.level[s[fails]], t[fails]]
                fails = fails[arc[fails] < 0]
            real = t >= begin[:live]
            out[t[real]] = (lost + self.arc_weight[arc])[real]
            state[:live] = self.arc_target[arc]
        return self.base[g.at[1]], out


def _send(batches: Iterator[pa.RecordBatch], folder: str, order: int, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    task = TaskContext.get()
    numbers = count()

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        batch = t.to_batches()[0]
        data, off = column(batch, "text")
        name = hashlib.blake2b(digest_size=16)
        name.update(data)
        name.update(off)
        name.update(repr(batch.column("id").to_pylist()).encode())
        name = f"{name.hexdigest()}-{task.partitionId() if task else 0}-{next(numbers)}"  # equal blocks are two

        def write(f) -> None:
            with pa.ipc.new_file(f, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)

        put(folder, name, write)
        g = Grams(data, off, order)
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)[g.doc]
        rows = []
        for n, keys in g.keys.items():
            at = g.at[n][train]
            counts = np.bincount(at[at >= 0], minlength=len(keys)).astype(np.uint32)
            bucket = ((keys >> _U(key_bits(n) - 32)) * _U(buckets) >> _U(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows += [(name, n, int(bucket[a]), _packed_keys(keys[a:b]), _packed(counts[a:b])) for a, b in zip(cut, np.append(cut[1:], len(keys)))]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["block", "n", "bucket", "keys", "counts"])

    for batch in batches:
        data, off = column(batch, "text")
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + max(block_bytes - size, 0), "right")) - 1)
            b = min(b, batch.num_rows)
            held.append(batch.slice(a, b - a))
            size += int(off[b] - off[a])
            a = b
            if size >= block_bytes or a < batch.num_rows:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each run of rows with one (n, bucket)."""

    def total(rows: list[tuple]) -> pa.RecordBatch:
        keys = [_unpacked_keys(r[3]) for r in rows]
        counts = np.concatenate([_unpacked(r[4], np.uint32) for r in rows])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, counts, len(every)).astype(np.uint64)
        out, at = [], 0
        for r, k in zip(rows, keys):
            out.append((r[0], r[1], r[2], _packed(sums[inverse[at : at + len(k)]]), None, None))
            at += len(k)
        if rows[0][1] == 1:
            out.append((None, 1, rows[0][2], None, int(sums.sum()), int((sums > 0).sum())))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["block", "n", "bucket", "totals", "tokens", "words"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "bucket", "keys", "counts"))):
            if held and held[0][1:3] != row[1:3]:
                yield total(held)
                held = []
            held.append(row)
    if held:
        yield total(held)


def _score(batches: Iterator[pa.RecordBatch], folder: str, order: int, tokens: int, words: int, prior: float) -> Iterator[pa.RecordBatch]:
    def block(rows: list[tuple]) -> pa.RecordBatch:
        where, path = opened(folder)
        with where.open_input_file(f"{path}/{rows[0][0]}") as f:
            batch = pa.ipc.open_file(f).read_all().combine_chunks().to_batches()[0]
        g = Grams(*column(batch, "text"), order)
        counts = {n: np.concatenate([np.zeros(0, np.uint64), *(_unpacked(r[3], np.uint64) for r in rows if r[1] == n)]).astype(np.float64) for n in g.keys}
        if any(len(counts[n]) != len(k) for n, k in g.keys.items()):
            raise ValueError(f"block {rows[0][0]}: totals are missing; write the documents to a table first")
        base, weight = Automaton(g, counts, tokens, words, prior).traverse()
        docs = batch.num_rows
        return pa.record_batch(
            [
                batch.column("id"),
                batch.column("train"),
                pa.array(g.tokens, pa.int64()),
                pa.array(np.bincount(g.doc, counts[1][g.at[1]] > 0, docs).astype(np.int64)),
                pa.array(np.full(docs, tokens), pa.int64()),
                pa.array(np.bincount(g.doc, base, docs)),
                pa.array(np.bincount(g.doc, weight, docs)),
            ],
            ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "bucket", "totals"))):
            if held and held[0][0] != row[0]:
                yield block(held)
                held = []
            held.append(row)
    if held:
        yield block(held)


def score_texts(docs: DataFrame, train: Column, order: int = 3, id: str = "doc_id", text: str = "text", prior: float = PRIOR, block_bytes: int = 6_000_000, bucket_bytes: int = 4_000_000) -> DataFrame:
    """Per row of ``docs``: its id, held_out, n_tokens, n_known, train_tokens, base_score and score; no other columns.

    ``train``: which rows the model learns from. ``order``: words of the longest n-gram.
    """
    spark = docs.sparkSession
    direct(spark)
    small_batches(spark)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-size // bucket_bytes) or 1
    folder = new_path(spark, "blocks")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))  # these numbers are kept by adaptive execution
    sent = rows.mapInArrow(lean(lambda it: _send(it, folder, order, buckets, block_bytes)), "block string, n int, bucket int, keys binary, counts binary")
    sums = sent.repartition(tasks, "n", "bucket").sortWithinPartitions("n", "bucket").mapInArrow(lean(_add), "block string, n int, bucket int, totals binary, tokens long, words long")
    sums, sums_path = written(sums, "totals")
    known = sums.where("block is null").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, words = known[0] or 0, known[1] or 0
    runs = sums.where("block is not null").select("block", "n", "bucket", "totals").repartition(tasks, "block").sortWithinPartitions("block", "n", "bucket")
    schema = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out, path = written(runs.mapInArrow(lean(lambda it: _score(it, folder, order, tokens, words, prior)), schema), "scores")
    later(path)
    drop(spark, folder, sums_path)
    return out.select(F.col("id").alias(id), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
