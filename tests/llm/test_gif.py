import hashlib
import random
import zlib

import numpy as np

from loomwork.llm import gif


def slow_decode(stream, bits):
    """LZW by the book."""
    clear = 1 << bits
    table, width, prev, out, acc, have = None, bits + 1, None, b"", 0, 0
    it = iter(stream)
    while True:
        while have < width:
            acc |= next(it) << have
            have += 8
        code, acc, have = acc & (1 << width) - 1, acc >> width, have - width
        if code == clear:
            table, width, prev = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out, prev = out + entry, entry


def test_streams_round_trip():
    r = random.Random(3)
    for data in (b"", b"a", b"a" * 5000, bytes(range(256)) * 30, r.randbytes(30_000), b"".join(r.choice([b"the ", b"cat ", b"sat "]) for _ in range(20_000))):
        stream = gif.lzw_encode(data)
        assert gif.lzw_decode(stream, 8, len(data)) == data
        assert slow_decode(stream, 8) == data


def test_frames_compose_with_disposal_and_transparency():
    def frame(samples, w, h, left, top, disposal, clear):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + (7).to_bytes(2, "little") + bytes([clear or 0, 0])
        place = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + b"\x00\x08"
        return control + place + gif._chain(gif.lzw_encode(bytes(samples)))

    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + b"\xf7\x00\x00" + gif._GREY
    b = head + frame([10, 20, 30, 40], 2, 2, 0, 0, 1, None) + b"\x21\xfe\x02hi\x00" + frame([5, 99], 2, 1, 0, 0, 2, 99) + frame([7], 1, 1, 1, 1, 3, None) + frame([8], 1, 1, 0, 1, 0, None) + b"\x3b"
    frames = gif.decode(b)
    grey = [f.rgba[..., 0].ravel().tolist() for f in frames]
    alpha = [f.rgba[..., 3].ravel().tolist() for f in frames]
    assert grey == [[10, 20, 30, 40], [5, 20, 30, 40], [0, 0, 30, 7], [0, 0, 8, 40]]
    assert alpha == [[255] * 4, [255] * 4, [0, 0, 255, 255], [0, 0, 255, 255]]
    assert [(f.delay_cs, f.disposal, f.transparent) for f in frames] == [(7, 1, None), (7, 2, 99), (7, 3, None), (7, 0, None)]


def test_payload_columns(odd, none):
    out = gif.payload_media(odd, keep=["doc_id", "text"], with_media=True)
    rows = out.collect()
    assert len(rows) == 12
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        frames = gif.decode(bytes(r.media), False)
        assert b"".join(f.samples.tobytes() for f in frames) == payload
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        canvas, total = np.zeros((min(len(payload) // 192, 512), 192), np.uint8), np.zeros(8, int)
        for at in range(0, len(payload) // 192, 512):
            rows = np.frombuffer(payload, np.uint8).reshape(-1, 192)[at : at + 512]
            canvas[: len(rows)] = rows
            total += np.histogram(canvas, bins=8, range=(0, 256))[0]
        grey = ",".join(map(str, total))
        assert r.feature == f"{len(frames)};{10 * len(frames)};{grey};{grey};{grey}"
    assert gif.payload_media(none).count() == 0


def picture(samples, w, h, palette, disposal=0, clear=None, left=0, top=0):
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + (7).to_bytes(2, "little") + bytes([clear or 0, 0])
    place = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x81]) + bytes(palette)
    return control + place + b"\x02" + gif._chain(gif.lzw_encode(bytes(samples), 2))


def test_frames_table(spark):
    whole = gif.encode(b"ab" * 96 * 600)
    rows = spark.createDataFrame([(1, bytearray(whole), "e"), (2, bytearray(b"no gif"), "e"), (3, None, "e"), (4, bytearray(whole[:900]), "e")], "id long, media binary, ERROR string")
    out = gif.frames_table(rows).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.start_cs, r.height) for r in out[:2]] == [(1, 0, 0, 512), (1, 1, 10, 512)]
    assert sum(out[0].red) == sum(out[1].blue) == 192 * 512 and len(out[0].pixels) == 4 * 192 * 512
    assert [r.id for r in out if r.error] == [2, 3, 4]


def test_histograms_are_of_colours_of_the_displayed_frame(spark):
    palette = [200, 0, 0, 0, 102, 0, 0, 0, 250, 9, 9, 9]  # red, a green as bright, blue
    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + b"\x00\x00\x00"
    b = head + picture([0, 1, 2, 0], 2, 2, palette, disposal=1) + picture([1, 3], 2, 1, palette, clear=3) + b"\x3b"
    out = gif.frames_table(spark.createDataFrame([(bytearray(b),)], "media binary")).orderBy("frame").collect()
    assert [r.red for r in out] == [[2, 0, 0, 0, 0, 0, 2, 0], [3, 0, 0, 0, 0, 0, 1, 0]]
    assert [r.green for r in out] == [[3, 0, 0, 1, 0, 0, 0, 0], [2, 0, 0, 2, 0, 0, 0, 0]]
    assert [r.blue for r in out] == [[3, 0, 0, 0, 0, 0, 0, 1]] * 2
    assert bytes(out[1].pixels[:4]) == bytes([0, 102, 0, 255])


def test_broken_images_give_errors(spark):
    """Whatever byte is changed: frames or an error, no exception, no large allocation."""
    r = random.Random(1)
    text = b"".join(r.choice([b"the ", b"cat ", b"sat "]) for _ in range(500))
    whole = gif.encode(text + b" " * (-len(text) % 192))
    cases = []
    for _ in range(2000):
        x = bytearray(whole)
        at = r.randrange(len(x)) if r.random() < 0.5 else r.choice([*range(14), *range(781, 812)])
        x[at] = r.randrange(256)
        cases.append((x,))
    for size in range(256):
        x = bytearray(whole)
        x[whole.index(b"\x2c", 781) + 10] = size
        cases.append((x,))
    huge = bytearray(whole)
    huge[6:10] = b"\xff" * 4
    at = whole.index(b"\x2c", 781)
    wide = bytearray(whole)
    wide[at + 5 : at + 9] = b"\xff" * 4
    cases += [(huge,), (wide,), (bytearray(whole[:20]),), (bytearray(b"GIF89a"),)]
    out = gif.frames_table(spark.createDataFrame(cases, "media binary"), with_pixels=False)
    assert out.where("error is null").count() > 100 and out.where("error is not null").count() > 260
    assert {r.error[:10] for r in gif.frames_table(spark.createDataFrame([(huge,), (wide,)], "media binary")).collect()} == {"ValueError"}


def test_clashing_names(spark, odd):
    out = gif.payload_media(odd.withColumn("Feature", odd.lang).withColumn("media", odd.lang))
    assert out.columns[:8] == [*odd.columns, "media"] and out.select("media", "score").distinct().count() == odd.select(odd.lang, "score").distinct().count()
