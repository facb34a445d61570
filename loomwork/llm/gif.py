"""GIF images as tables: LZW streams, palettes, disposal, transparency, timed frames, histograms.

``decode`` is a full reader of GIF87a/89a: global and local palettes, interlacing, sub-images,
transparent indices, disposal to background or previous, delays, comments and other extensions.
``encode`` stores 8-bit samples losslessly as frames of a grey palette. ``payload_media`` is the
column operator: every text becomes a GIF, which is then read back from its bytes.

Every displayed frame is composed on the canvas by the rules of disposal and transparency. ``frames_table``
stores its pixels, its time and the histograms of its red, green and blue.

Writing LZW is sequential, so this is Python; an image is one row, so memory is that of one batch and one image.
Null and empty texts give one block of padding. Broken images give an error text instead of frames, never a
failed task: code sizes other than 2 to 8, and frames or canvases of more than MAX_SAMPLES samples or more than
their streams could fill, are errors before anything is allocated. A stream that ends early leaves the missing
samples at the background. Repeated rows are each returned; equal texts have equal values. Columns that are
named as added ones are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwork.llm._columns import others
from loomwork.llm._store import lean, small_batches

ROW = 192
MAX_ROWS = 512
#: Samples of a frame, and of the canvas, at most; 64 million are 256 MB of composed pixels.
MAX_SAMPLES = 1 << 26
BINS = 8
_GREY = bytes(x for v in range(256) for x in (v, v, v))


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """GIF's LZW with a clear code whenever the table is full."""
    clear = 1 << bits
    codes, marks = [clear], []
    table: dict[int, int] = {}
    get, emit = table.get, codes.append
    n = clear + 2
    if data:
        cur = data[0]
        for b in memoryview(data)[1:]:
            key = cur << 8 | b
            code = get(key)
            if code:
                cur = code
                continue
            emit(cur)
            cur = b
            if n < 4096:
                table[key] = n
                n += 1
            else:
                marks.append(len(codes))
                emit(clear)
                table.clear()
                n = clear + 2
        emit(cur)
    emit(clear + 1)
    value = np.array(codes, np.uint32)
    # the i-th code after a clear is written when the table has clear + 1 + i entries
    since = np.arange(len(value)) - np.repeat([0, *marks], np.diff([0, *marks, len(value)]))
    width = np.ceil(np.log2(np.clip(clear + 1 + since, 1 << bits + 1, 4096))).astype(np.int64)
    for m in marks:  # a clear code has the width of the table before it
        width[m] = 12
    width[0] = bits + 1
    start = np.cumsum(width) - width
    out = np.zeros((int(start[-1] + width[-1]) + 7) // 8 + 4, np.uint8)
    shifted = value << (start & 7).astype(np.uint32)
    at = start >> 3
    for k in range(3):
        np.bitwise_or.at(out, at + k, (shifted >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8))
    return out[: (int(start[-1] + width[-1]) + 7) // 8].tobytes()


def _unpack(bytes8: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Codes of ``width`` bits (12 at most) at bit positions ``start``."""
    at = start >> 3
    word = bytes8[at].astype(np.int64) | bytes8[at + 1].astype(np.int64) << 8 | bytes8[at + 2].astype(np.int64) << 16
    return word >> (start & 7) & (1 << width) - 1


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """At most ``size`` samples of an LZW stream.

    The codes between two clear codes have known widths, so they are cut at once. Entry k of the
    table is what code k wrote and the sample after it, so each sample of a code above the literals
    points to an earlier sample; pointer doubling resolves them all.
    """
    if not 2 <= bits <= 8:
        raise ValueError(f"LZW codes of {bits} bits")
    clear, room = 1 << bits, 4096 - (1 << bits) - 2
    packed = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)])
    parts, got, at, end = [], 0, 0, 8 * len(stream)
    ended = False
    while got < size and not ended:
        j = 4096
        while True:
            entries = clear + 2 + np.minimum(np.maximum(np.arange(j) - 1, 0), room)
            width = np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)
            stop = np.cumsum(width) + at
            fits = int(np.searchsorted(stop, end, "right"))
            code = _unpack(packed, stop[:fits] - width[:fits], width[:fits])
            marks = np.flatnonzero((code == clear) | (code == clear + 1))
            if len(marks) or fits < j:
                break
            j *= 2
        m = int(marks[0]) if len(marks) else fits
        ended = not len(marks) or code[m] == clear + 1
        if len(marks):
            at = int(stop[m])
        code = code[:m]
        if not m:
            continue
        plain = code < clear
        k = code - clear - 2
        if not (plain | (k < np.minimum(np.arange(m), room))).all():
            raise ValueError("an LZW code before it is defined")
        back = np.where(plain, np.arange(m), k)
        length = np.where(plain, 0, 1)
        p = back
        while not plain[p].all():
            length = length + length[p]
            p = p[p]
        length = length + length[p] + 1
        start = np.cumsum(length) - length
        m = int(np.searchsorted(start, size - got))  # codes beyond the last sample wanted aren't written
        back, plain, length, start, code = back[:m], plain[:m], length[:m], start[:m], code[:m]
        owner = np.repeat(np.arange(m), length)
        place = np.arange(len(owner))
        source = place + (start[back] - start)[owner]
        while True:
            deeper = source[source]
            if np.array_equal(deeper, source):
                break
            source = deeper
        base = np.zeros(len(owner), np.uint8)
        base[start[plain]] = code[plain]
        parts.append(base[source])
        got += len(owner)
    return np.concatenate(parts)[:size].tobytes() if parts else b""


@dataclass
class Frame:
    """One image block. ``samples``: palette indices (height, width); ``rgba``: the canvas after it."""

    left: int
    top: int
    samples: np.ndarray
    delay_cs: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    rgba: np.ndarray | None = field(default=None, repr=False)


def _blocks(b: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = b[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(b[at + 1 : at + 1 + n])
        at += n + 1


def decode(b: bytes, render: bool = True) -> list[Frame]:
    """All frames; with ``render`` also the composed canvas of each."""
    if b[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    w, h, flags = int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little"), b[10]
    at, common = 13, None
    if flags & 128:
        n = 2 << (flags & 7)
        common = np.frombuffer(b[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
    frames: list[Frame] = []
    if w * h > MAX_SAMPLES:
        raise ValueError(f"a canvas of {w} x {h}")
    canvas = np.zeros((h, w, 4), np.uint8) if render else None
    delay = disposal = 0
    clear: int | None = None
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = b[at + 1]
            body, at = _blocks(b, at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"block {kind}")
        left, top, fw, fh = (int.from_bytes(b[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        local = b[at + 9]
        at += 10
        palette = common
        if local & 128:
            n = 2 << (local & 7)
            palette = np.frombuffer(b[at : at + 3 * n], np.uint8).reshape(-1, 3)
            at += 3 * n
        bits = b[at]
        stream, at = _blocks(b, at + 1)
        if fw * fh > min(MAX_SAMPLES, 4096 * (8 * len(stream) // 3 + 1)):  # a code writes 4096 samples at most
            raise ValueError(f"a frame of {fw} x {fh} from {len(stream)} bytes")
        flat = np.zeros(fw * fh, np.uint8)
        got = np.frombuffer(lzw_decode(stream, bits, fw * fh), np.uint8)
        flat[: len(got)] = got
        samples = flat.reshape(fh, fw)
        if local & 64:
            rows = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
            straight = np.empty_like(samples)
            straight[rows] = samples
            samples = straight
        if palette is None:
            palette = np.frombuffer(_GREY, np.uint8).reshape(-1, 3)
        frame = Frame(left, top, samples, delay, disposal, clear, palette)
        if canvas is not None:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + fh, left : left + fw]
            seen = samples[: area.shape[0], : area.shape[1]]
            drawn = np.ones(seen.shape, bool) if clear is None else seen != clear
            area[drawn, :3] = palette[np.minimum(seen, len(palette) - 1)][drawn]
            area[drawn, 3] = 255
            frame.rgba = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif before is not None:
                canvas = before
        frames.append(frame)
        delay = disposal = 0
        clear = None
    return frames


def _chain(stream: bytes) -> bytes:
    parts = []
    for i in range(0, len(stream), 255):
        piece = stream[i : i + 255]
        parts += [bytes([len(piece)]), piece]
    return b"".join(parts) + b"\x00"


def encode(samples: bytes, row: int = ROW, max_rows: int = MAX_ROWS, delay_cs: int = 10) -> bytes:
    """A GIF whose frames hold the samples in order: rows of ``row``, at most ``max_rows`` a frame."""
    rows = len(samples) // row
    size = row.to_bytes(2, "little") + min(rows, max_rows).to_bytes(2, "little")
    parts = [b"GIF89a", size, b"\xf7\x00\x00", _GREY]
    for r in range(0, rows, max_rows):
        n = min(max_rows, rows - r)
        parts += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\x00\x00", b"\x2c\x00\x00\x00\x00", row.to_bytes(2, "little"), n.to_bytes(2, "little"), b"\x00\x08"]
        parts.append(_chain(lzw_encode(samples[r * row : (r + n) * row])))
    return b"".join(parts) + b"\x3b"


def histograms(rgba: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(3, bins): pixels of a composed frame by their red, green and blue, in equal bins; transparent ones are left out."""
    pixels = rgba.reshape(-1, 4)
    shown = pixels[:, 3] > 0
    if not shown.all():
        pixels = pixels[shown]
    n = [np.bincount(pixels[:, c], minlength=256) for c in range(3)]
    return np.stack([np.bincount(np.arange(256) * bins // 256, x, bins) for x in n]).astype(np.int64)


FRAME = "frame int, start_cs long, delay_cs int, width int, height int, disposal int, transparent int, red array<long>, green array<long>, blue array<long>, pixels binary, error string"


def frames_table(df: DataFrame, media: str = "media", bins: int = BINS, with_pixels: bool = True) -> DataFrame:
    """A row per frame of the binary column ``media``: the other columns, then frame, start_cs, delay_cs, width and height
    (of the canvas), disposal, transparent, the histograms red, green and blue of the displayed frame, its pixels (RGBA,
    row by row; null without ``with_pixels``), and error (set, with null frame, for what can't be read)."""
    added = T.StructType.fromDDL(FRAME)
    kept = others([c for c in df.columns if c != media], *added.names)
    schema = T.StructType([*(df.schema[c] for c in kept), *added.fields])
    kinds = (*(pa.int32() if t in (0, 2, 3, 4, 5, 6) else pa.int64() for t in range(7)), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(batch.column(media)):  # an image at a time, as its frames may be large
                found = []
                try:
                    start = 0
                    for k, f in enumerate(decode(b.as_py() or b"")):
                        colours = histograms(f.rgba, bins).tolist()
                        h, w = f.rgba.shape[:2]
                        found.append((k, start, f.delay_cs, w, h, f.disposal, f.transparent, *colours, f.rgba.tobytes() if with_pixels else None, None))
                        start += f.delay_cs
                except (ArithmeticError, LookupError, MemoryError, TypeError, ValueError) as e:
                    found = [(None,) * 11 + (f"{type(e).__name__}: {e}",)]
                part = batch.take(pa.array([i] * len(found), pa.int64()))
                yield pa.record_batch([*(part.column(c) for c in kept), *(pa.array([x[k] for x in found], t) for k, t in enumerate(kinds))], schema.names)

    small_batches(df.sparkSession)
    return df.select(*kept, media).mapInArrow(lean(run), schema)


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_media(df: DataFrame, text: str = "text", keep: list[str] | None = None, with_media: bool = False) -> DataFrame:
    """Stores each text's padded bytes as a GIF, reads it back and describes what was read.

    ``feature``: frames, duration in 1/100 s, and the red, green and blue histograms summed over the displayed
    frames. ``with_media`` also returns the stored bytes as ``media``.
    """
    added = T.StructType.fromDDL(MEDIA + (", media binary" if with_media else ""))
    kept = others(keep or df.columns, *added.names)
    schema = T.StructType([*(df.schema[c] for c in kept), *added.fields])

    def one(raw: bytes) -> tuple:
        media = encode(raw + b" " * (-len(raw) % ROW if raw else ROW))
        frames = decode(media)
        back = b"".join(f.samples.tobytes() for f in frames)
        colours = sum(histograms(f.rgba) for f in frames)
        feature = ";".join([str(len(frames)), str(sum(f.delay_cs for f in frames)), *(",".join(map(str, x)) for x in colours.tolist())])
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            found, done = [], {}
            for x in texts:
                raw = x.as_py() or b""
                if raw not in done:
                    done[raw] = one(raw) if with_media else one(raw)[:7]
                found.append(done[raw])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array([x[k] for x in found], kinds[k]) for k in range(len(added)))], schema.names)

    small_batches(df.sparkSession)
    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(lean(run), schema)
