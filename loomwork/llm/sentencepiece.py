"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

A batch's distinct words (a space mark and what follows up to the next space) are concatenated and
its suffixes sorted; every piece of the vocabulary is binary-searched for the range of suffixes that
begin with it. Each range gives edges (start, end, piece), which are sorted by position and relaxed
from left to right. In a BPE model the path is not the best sum of scores but the one that merging
makes: a prefix's encoding ends in the one piece that may follow the encoding of the rest, and
whether two pieces may stand side by side is decided by undoing their merges in turn. Runs of space
marks merge last and among themselves, so they are looked up by length. Characters without a piece
become bytes.

One Arrow pass, no shuffle; memory for one batch and, in each Python worker, for the pieces of KEPT_WORDS words that were met
lately: words come again, so most of a batch's needn't be matched. Models with identity normalisation, a dummy
prefix and byte fallback are taken (others raise ValueError). Null and empty texts have no pieces.
A space mark (U+2581) in a text counts as a space, as in the format. Repeated rows are each returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwork.llm._columns import others
from loomwork.llm._store import lean, small_batches
from loomwork.llm._words import Words, chunks, mix

MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[32] = False
_U = np.uint64
_NONE = 1 << 30
#: Distinct words are matched in parts of about so many bytes.
PART = 300_000
_CACHE_BITS = 20
#: A worker keeps the pieces of so many words, of so many pieces in all; words of more than LONG_WORD pieces aren't kept.
KEPT_WORDS, KEPT_PIECES, LONG_WORD = 1 << 20, 5 << 20, 64


@dataclass
class Model:
    """Pieces by order of merging: ``ids[o]``, ``raw[o]``; characters first, then four stand-ins for unknown
    characters of 1 to 4 bytes, then merged pieces. ``left``/``right``: what a piece is merged from (itself: nothing)."""

    ids: np.ndarray
    raw: list[bytes]
    chars: int
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray
    pair_makes: np.ndarray
    bytes_id: np.ndarray
    mark: int
    runs: dict[int, list[int]]
    longest_run: int
    text_of: list[bytes]
    digest: bytes

    @property
    def unknown(self) -> int:
        return self.chars - 4


def _merge(parts: list[str], order: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merges neighbours of the least order, of equal ones the leftmost; and the last merge."""
    last = None
    while len(parts) > 1:
        o, k = min((order.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if o == _NONE:
            break
        last = parts[k], parts[k + 1]
        parts = parts[:k] + [parts[k] + parts[k + 1]] + parts[k + 2 :]
    return parts, last


_MODELS: dict[str, Model] = {}


def load_model(path: str) -> Model:
    if path in _MODELS:
        return _MODELS[path]
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        raw = f.read()
    proto = pb.ModelProto.FromString(raw)
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    if trainer.model_type != 2 or not trainer.byte_fallback or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or spec.precompiled_charsmap:
        raise ValueError("a BPE model with byte fallback, a dummy prefix and identity normalisation is needed")
    kinds = proto.SentencePiece
    normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
    if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in normal):
        raise ValueError("a piece goes across a space")
    marks = {p for p in normal if len(p) > 1 and not p.strip(MARK)}
    merged = sorted((p for p in normal if len(p) > 1 and p not in marks), key=lambda p: (-normal[p][1], normal[p][0]))
    chars = [p for p in normal if len(p) == 1]
    c = len(chars) + 4
    order = {p: c + i for i, p in enumerate(merged)}
    number = {p: i for i, p in enumerate(chars)} | order
    names = chars + [""] * 4 + merged
    left, right, reachable = np.arange(len(names)), np.arange(len(names)), np.ones(len(names), bool)
    for p in merged:
        parts, last = _merge(list(p), order)
        if len(parts) > 1:
            reachable[number[p]] = False
        else:
            left[number[p]], right[number[p]] = number[last[0]], number[last[1]]
    pairs = [(number[p[:k]] * len(names) + number[p[k:]], number[p]) for p in merged for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
    pairs.sort()
    # runs of marks: scores tie, so the leftmost merges first
    rank = {s: i for i, s in enumerate(sorted({normal[p][1] for p in marks}, reverse=True))}
    mark_order = {p: rank[normal[p][1]] for p in marks}
    longest = max(map(len, marks), default=1)
    runs = {n: [normal[x][0] for x in _merge([MARK] * n, mark_order)[0]] for n in range(2 * longest + 1)}
    texts = []
    for i, p in enumerate(proto.pieces):
        byte = bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else None
        texts.append(byte if byte is not None else b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode())
    byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    model = Model(
        np.array([normal[p][0] if p else -1 for p in names]), [p.encode() if reachable[i] else b"" for i, p in enumerate(names)], c, left, right,
        np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([byte_ids[b] for b in range(256)]), number[MARK], runs, longest, texts, hashlib.blake2b(raw, digest_size=16).digest(),
    )
    _MODELS[path] = model
    return model


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] of them), lo[1], ..."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(lo - ends + n, n)


class Encoder:
    """Works on words; keeps what it needs of the vocabulary and a bounded table of decided pairs."""

    def __init__(self, model: Model):
        self.m = model
        self.width = max(map(len, model.raw))
        known = [(r, o) for o, r in enumerate(model.raw) if r]
        short = [(r, o) for r, o in known if len(r) <= 8]
        long = [(r, o) for r, o in known if len(r) > 8]
        number = lambda b: int.from_bytes(b, "big")
        self.low = np.array([number(r.ljust(8, b"\x00")) for r, _ in short], np.uint64)
        self.high = np.array([number(r.ljust(8, b"\xff")) for r, _ in short], np.uint64)
        self.short = np.array([o for _, o in short])
        self.heads = np.unique(np.array([number(r[:8]) for r, _ in long], np.uint64))
        self.long_low = np.array([r for r, _ in long], f"S{self.width}")
        self.long_high = np.array([r.ljust(self.width, b"\xff") for r, _ in long], f"S{self.width}")
        self.long = np.array([o for _, o in long], np.int64)
        self.size = np.array([len(r) for r in model.raw])
        self.size[model.unknown : model.chars] = [1, 2, 3, 4]
        self.key = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.may = np.zeros(1 << _CACHE_BITS, bool)

    def decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a, b side by side: undo the later merge of the two, as long as no merge across would have come first."""
        m, n = self.m, len(self.m.ids)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(live):
            k = a * n + b
            at = np.minimum(np.searchsorted(m.pair, k), len(m.pair) - 1)
            across = np.where(m.pair[at] == k, m.pair_makes[at], _NONE)
            bad = across < limit
            ok[live[bad]] = False
            go = ~bad & ((a >= m.chars) | (b >= m.chars))
            a, b, live = a[go], b[go], live[go]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, m.right[a], a), np.where(first, b, m.left[b])
        return ok

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``decide`` through the table."""
        k = a * len(self.m.ids) + b
        slot = (mix(k.astype(np.uint64)) >> _U(64 - _CACHE_BITS)).astype(np.int64)
        ok = self.may[slot]
        new = np.flatnonzero(self.key[slot] != k)
        if len(new):
            some, back = np.unique(k[new], return_inverse=True)
            found = self.decide(*np.divmod(some, len(self.m.ids)))
            ok[new] = found[back]
            self.key[slot[new]], self.may[slot[new]] = k[new], ok[new]
            # of keys that share a slot one was stored last, maybe with the other's answer
            torn = self.key[slot[new]] != k[new]
            self.key[slot[new][torn]] = -1
        return ok

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of all occurrences in ``text``, by its suffix array."""
        pad = np.concatenate([text, np.full(self.width, 255, np.uint8)])
        n = len(text)
        head = np.zeros(n, np.uint64)
        for i in range(8):
            head = head << _U(8) | pad[i : i + n]
        order = np.argsort(head)  # equal ones in any order: edges are sorted by position later
        head = head[order]
        lo, hi = np.searchsorted(head, self.low), np.searchsorted(head, self.high, "right")
        start, piece = [order[_spread(lo, hi - lo)]], [np.repeat(self.short, hi - lo)]
        if len(self.heads):
            place = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
            deep = order[self.heads[place] == head]
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(pad, self.width)[deep]).view(f"S{self.width}").ravel()
            by = np.argsort(rows, kind="stable")
            rows = rows[by]
            lo, hi = np.searchsorted(rows, self.long_low), np.searchsorted(rows, self.long_high, "right")
            start.append(deep[by[_spread(lo, hi - lo)]])
            piece.append(np.repeat(self.long, hi - lo))
        return np.concatenate(start), np.concatenate(piece)

    def encode(self, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of the words text[first:end]: (flat, number by word, start of each flat piece in ``text``)."""
        m = self.m
        start, piece = self.edges(text)
        lead = (text & 0xC0) != 0x80
        width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        known = np.zeros(len(text), bool)
        known[start[piece < m.chars]] = True
        lost = np.flatnonzero(lead & ~known & (text != 255))
        start = np.concatenate([start, lost])
        piece = np.concatenate([piece, m.unknown + width[lost] - 1])
        word = np.zeros(len(text) + 1, np.int64)
        word[first] = 1
        word = np.cumsum(word) - 1
        depth = start - first[word[start]]
        if len(depth) and depth.max() < 65_536:
            depth = depth.astype(np.uint16)
        by = np.argsort(depth, kind="stable")
        start, piece, depth = start[by], piece[by], depth[by]
        stop = start + self.size[piece]
        last = np.full(len(text) + 2, -1)
        came = np.zeros(len(text) + 2, np.int64)
        cut = np.flatnonzero(np.diff(depth, prepend=depth[:1])) if len(depth) else np.zeros(0, int)
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(depth)]):
            s, t, e = start[a:b], piece[a:b], stop[a:b]
            if a:
                before = last[s]
                good = before >= 0
                s, t, e, before = s[good], t[good], e[good], before[good]
                good = self.allowed(before, t)
                s, t, e = s[good], t[good], e[good]
            last[e], came[e] = t, s
        if (last[end] < 0).any():
            raise ValueError("a word can't be encoded")
        place, who = end.copy(), np.arange(len(end))
        steps = []
        while len(who):
            steps.append((who, last[place], came[place]))
            place = came[place]
            go = place > first[who]
            who, place = who[go], place[go]
        owner, flat, at = (np.concatenate([s[k] for s in reversed(steps)]) if steps else np.zeros(0, np.int64) for k in range(3))
        by = np.argsort(owner, kind="stable")
        return flat[by], np.bincount(owner, minlength=len(end)), at[by]

    def ids(self, flat: np.ndarray, count: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model ids of pieces, with bytes for unknown characters: (flat, number by word)."""
        m = self.m
        lost = (flat >= m.unknown) & (flat < m.chars)
        n = np.where(lost, self.size[flat], 1)
        out = np.repeat(m.ids[flat], n)
        if lost.any():
            out[np.repeat(lost, n)] = m.bytes_id[text[_spread(at[lost], n[lost])]]
        word = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(word, n, len(count)).astype(np.int64)

    def run(self, n: int) -> list[int]:
        """Ids of n space marks."""
        whole = self.m.longest_run
        extra = max(0, (n - whole) // whole)
        return self.m.runs[whole] * extra + self.m.runs[n - extra * whole]


def _texts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Space marks in texts are spaces."""
    raw = data.tobytes()
    if MARK.encode() not in raw:
        return data, off
    parts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1], off[1:])]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


class Batch:
    """Encodes texts; distinct words of all of them are matched once, those that are kept from earlier texts not at all."""

    def __init__(self, encoder: Encoder):
        self.e = encoder
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _keep(self, words: np.ndarray, place: np.ndarray, n: np.ndarray, flat: np.ndarray) -> None:
        """Keeps the sorted ``words``, whose pieces are ``flat[place : place + n]``, and nothing else."""
        self.words, self.n, self.flat = words, n, flat[_spread(place, n)]
        self.place, self.used = np.cumsum(n) - n, np.zeros(len(words), bool)

    def _pieces(self, words: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the sorted distinct ``words`` data[start:end]: (flat, place of each word's first, number by word)."""
        at = np.searchsorted(self.words, words)
        hit = np.zeros(len(words), bool)
        inside = np.flatnonzero(at < len(self.words))
        hit[inside] = self.words[at[inside]] == words[inside]
        self.used[at[hit]] = True
        new = np.flatnonzero(~hit)
        more, n_more = self._units(data, start[new], end[new])
        flat = np.concatenate([self.flat, more])
        place, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        place[hit], n[hit] = self.place[at[hit]], self.n[at[hit]]
        place[new], n[new] = len(self.flat) + np.cumsum(n_more) - n_more, n_more
        short = new[n_more <= LONG_WORD]
        if len(self.words) + len(short) <= KEPT_WORDS and len(flat) <= KEPT_PIECES:
            self.words, self.place, self.n, self.used = (np.insert(x, at[short], y) for x, y in ((self.words, words[short]), (self.place, place[short]), (self.n, n[short]), (self.used, False)))
            self.flat = flat
        else:  # those met since the last time stay, if they are at most half
            old = np.flatnonzero(self.used)
            if len(old) > KEPT_WORDS // 2 or self.n[old].sum() > KEPT_PIECES // 2:
                old = old[:0]
            kept = self.words[old], self.place[old], self.n[old]
            if len(old) + len(short) <= KEPT_WORDS and self.n[old].sum() + n[short].sum() <= KEPT_PIECES:
                spot = np.searchsorted(kept[0], words[short])
                kept = tuple(np.insert(x, spot, y[short]) for x, y in zip(kept, (words, place, n)))
            self._keep(*kept, flat)
        return flat, place, n

    def encode(self, data: np.ndarray, off: np.ndarray, step: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number by text)."""
        data, off = _texts(data, off)
        pieces = []
        a = 0
        while a < len(off) - 1:  # hashing needs several times the bytes
            b = max(a + 1, int(np.searchsorted(off, off[a] + step, "right")) - 1)
            w = Words(data[off[a] : off[b]], off[a : b + 1] - off[a], _NOT_SPACE, lower=False)
            pieces.append((w.hashes(), w.start + off[a], w.end + off[a], w.count))
            a = b
        h, start, end, count = (np.concatenate([p[k] for p in pieces]) if pieces else np.zeros(0, np.int64) for k in range(4))
        words, sample, unit = np.unique(h, return_index=True, return_inverse=True)
        flat, place, n = self._pieces(words, data, start[sample], end[sample])
        # space marks before each word: the gap, and the dummy prefix before a text's first
        doc = np.repeat(np.arange(len(count)), count)
        first = np.cumsum(count) - count
        edge = np.zeros(len(h), bool)
        edge[first[count > 0]] = True
        gap = start - np.concatenate([[0], end[:-1]]) if len(h) else start
        gap[edge] = start[edge] - off[doc[edge]] + 1
        alone = flat[place[unit]] == self.e.m.ids[self.e.m.mark]
        marks = np.where(alone, gap, gap - 1)
        take, skip = n[unit] - alone, place[unit] + alone
        # a text's last spaces are one more word without letters
        tail = np.where(count > 0, off[1:] - end[np.maximum(first + count - 1, 0)] if len(end) else 0, np.where(off[1:] > off[:-1], off[1:] - off[:-1] + 1, 0))
        some = np.flatnonzero(tail)
        spot = (first + count)[some]
        marks = np.insert(marks, spot, tail[some])
        take, skip, doc = np.insert(take, spot, 0), np.insert(skip, spot, 0), np.insert(doc, spot, some)
        total = take.copy()
        spaced = np.flatnonzero(marks)
        lists = [self.e.run(x) for x in marks[spaced].tolist()]
        extra = np.zeros(len(take), np.int64)
        extra[spaced] = [len(x) for x in lists]
        total += extra
        out = np.empty(int(total.sum()), np.int32)
        begin = np.cumsum(total) - total
        out[_spread(begin + extra, take)] = flat[_spread(skip, take)]
        if lists:
            out[_spread(begin[spaced], extra[spaced])] = [i for x in lists for i in x]
        return out, np.bincount(doc, total, len(count)).astype(np.int64)

    def _units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start + 4
        flats, counts = [], []
        stop = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + PART, "right")))
            n = size[a:b]
            head = np.cumsum(n) - n
            text = np.full(int(n.sum()), 255, np.uint8)
            for i in range(3):
                text[head + i] = _MARK[i]
            text[_spread(head + 3, n - 4)] = data[_spread(start[a:b], n - 4)]
            found = self.e.ids(*self.e.encode(text, head, head + n - 1), text)
            flats.append(found[0].astype(np.int32))
            counts.append(found[1])
            a = b
        return (np.concatenate(flats), np.concatenate(counts)) if flats else (np.zeros(0, np.int32), np.zeros(0, np.int64))


_BATCH: dict[bytes, Batch] = {}


def _batch(model: Model) -> Batch:
    """This process's Batch of a model; the last one stays for the tasks to come."""
    if model.digest not in _BATCH:
        _BATCH.clear()
        _BATCH[model.digest] = Batch(Encoder(model))
    return _BATCH[model.digest]


def decode_ids(ids: np.ndarray, count: np.ndarray, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Bytes of lists of ids, and offsets: pieces' texts, without the first space of each list."""
    size = np.array([len(t) for t in texts])
    place = np.cumsum(size) - size
    table = np.frombuffer(b"".join(texts), np.uint8)
    flat = table[_spread(place[ids], size[ids])] if len(ids) else table[:0]
    total = np.diff(np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(count)])])
    off = np.concatenate([[0], np.cumsum(total)])
    led = np.flatnonzero(total)
    led = led[flat[off[led]] == 32]
    keep = np.ones(len(flat), bool)
    keep[off[led]] = False
    total[led] -= 1
    return flat[keep].tobytes(), np.concatenate([[0], np.cumsum(total)])


def encode_pieces(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``text`` by default) with ids array<int>, n_pieces and round_trip (decoding gives the text back)."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    names = [f.name for f in added]
    kept = others(keep if keep is not None else [c for c in df.columns if c != text], *names)
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _batch(sent.value)
        for batch in batches:
            for a, b, data, off in chunks(batch, text, 2_000_000):
                ids, count = encoder.encode(data, off)
                part = batch.slice(a, b - a)
                back, ends = decode_ids(ids, count, sent.value.text_of)
                raw = data.tobytes()  # with space marks as they came
                if back == raw and np.array_equal(ends, off):
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([back[ends[i] : ends[i + 1]] == raw[off[i] : off[i + 1]] for i in range(b - a)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
                for c in range(0, b - a, 1000):  # smaller batches for the JVM
                    cut = slice(c, min(c + 1000, b - a))
                    n = cut.stop - c
                    yield pa.record_batch([*(part.column(k).slice(c, n) for k in kept), lists.slice(c, n), pa.array(count[cut]), pa.array(same[cut])], [*kept, *names])

    schema = T.StructType([*(df.schema[c] for c in kept), *added])
    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(lean(run), schema)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of the list of ids; a null list gives null, an id outside the model an error.

    Bytes that aren't UTF-8 become U+FFFD.
    """
    kept = [c for c in df.columns if c != out]
    sent = df.sparkSession.sparkContext.broadcast(load_model(path).text_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column(ids).to_pylist():
                if x is None:
                    texts.append(None)
                    continue
                raw, _ = decode_ids(np.array(x, np.int64), np.array([len(x)]), sent.value)
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    return df.select(*kept).mapInArrow(lean(run), T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType())]))
