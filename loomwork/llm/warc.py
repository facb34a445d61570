"""WARC records in ZIP packages: written, and read by ranges without extraction.

A package is a ZIP file with two stored members, ``archive/data.warc.gz`` (a gzip member per record)
and ``indexes/index.cdx`` (offset and length of each record in it). The reader takes the end record,
the ZIP64 locator and directory if present, and the central directory; it finds the stored members
through their local headers, reads the index and cuts it into ranges of about ``split_bytes``, which are
spread over as many tasks as the packages hold such ranges. A package without an index is walked record
by record.

A task writes its packages under names of its own attempt, and only packages in the manifest that it
returns are read, so a lost or repeated task leaves no wrong record. Memory: one package of about
``package_bytes`` while writing, one range while reading, and the longest record.

A package or record that can't be read gives a row with ``error`` and ``path`` set, and what else is known of it; the
records around it are read. Records of other types than response and revisit come with what they state.

Null payloads are empty. Equal payloads of ``least`` bytes or more are stored once: the record with
the largest id is the response (repeated rows of that id all are), others are revisits of it. Null
ids count as smaller than any other. No rows: no package, and an empty result. Other columns of the pages aren't
stored. A url comes back as it was given: if its standard form differs, a further header field holds it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm._store import direct, later, lean, new_path, opened, small_batches, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOURCE = "X-Source-URI-Base64"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        standard = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
        head.append("WARC-Target-URI: " + standard)
        if standard != url:
            head.append(f"{SOURCE}: " + base64.b64encode(url.encode()).decode())
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORD = "page_id long, url string, record_type string, date string, refers_to long, payload_bytes long, payload_digest string, path string, error string"
FIELDS = [x.split()[0] for x in RECORD.split(", ")] + ["payload"]
#: What unreadable packages and records raise.
BROKEN = (ArithmeticError, LookupError, MemoryError, OSError, StopIteration, TypeError, ValueError, struct.error, zlib.error)


def parse(raw: bytes) -> dict:
    """Fields of one uncompressed record. A response's digest and length are those of its actual payload; other types'
    are those of the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def page(name: str) -> int | None:
        x = named.get(name, "").strip("<>").rpartition(":")[2]
        return int(x) if x.lstrip("-").isdigit() else None

    kind = named["warc-type"]
    url = base64.b64decode(named[SOURCE.lower()]).decode() if SOURCE.lower() in named else named.get("warc-target-uri")
    out = dict.fromkeys(FIELDS) | {"page_id": page("warc-record-id"), "url": url, "record_type": kind, "date": named.get("warc-date"), "refers_to": page("warc-refers-to")}
    said = named.get("warc-payload-digest")
    stated = base64.b32decode(said.rpartition(":")[2]).hex() if said else None
    if kind == "revisit":
        length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        return out | {"payload_bytes": length, "payload_digest": stated}
    if kind != "response":
        payload = block
    digest = hashlib.sha1(payload).hexdigest()
    if stated is not None and digest != stated:
        raise ValueError(f"record {out['page_id']}: payload digest {digest}, not {stated}")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def package(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP package of (index key, uncompressed record)."""
    warc, lines = io.BytesIO(), []
    for key, raw in records:
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        piece = z.compress(raw) + z.flush()
        lines.append(f"{key} {warc.tell()} {len(piece)}\n")
        warc.write(piece)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0)), warc.getbuffer())
        z.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "".join(lines))
    return out.getvalue()


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name: (data offset, size) of the stored members of a ZIP file, from its central directory.

    ``f``: seek and read. Compressed or encrypted members are left out.
    """

    def at(place: int, n: int) -> bytes:
        f.seek(place)
        b = f.read(n)
        if len(b) < n:
            raise ValueError("the ZIP file ends early")
        return b

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    count, _, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    length = struct.unpack("<I", tail[end + 12 : end + 16])[0]
    if count == 0xFFFF or offset == 0xFFFFFFFF or length == 0xFFFFFFFF:
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack("<QQQ", wide[32:56])
    directory, p, found = at(offset, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method = struct.unpack("<HH", directory[p + 8 : p + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        local = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                body = extra[q + 4 : q + 4 + width]
                values = iter(struct.unpack(f"<{len(body) // 8}Q", body[: len(body) // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            q += 4 + width
        p += 46 + n + m + k
        if method or flags & 1:
            continue
        head = at(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a broken local header")
        a, b = struct.unpack("<HH", head[26:30])
        found[name] = local + 30 + a + b, packed
    return found


def locate(f, size: int) -> list[tuple[int, int]]:
    """(offset, length) in the file of every gzip record of its stored WARC members."""
    inside = members(f, size)
    found = []
    for name, (start, length) in inside.items():
        if not name.startswith("archive/"):
            continue
        index = inside.get("indexes/index.cdx")
        if index and len([x for x in inside if x.startswith("archive/")]) == 1:
            f.seek(index[0])
            for line in f.read(index[1]).decode().splitlines():
                _, offset, n = line.rsplit(" ", 2)
                found.append((start + int(offset), int(n)))
            continue
        at = start
        while at < start + length:
            z, begin = zlib.decompressobj(31), at
            while not z.eof:
                f.seek(at)
                b = f.read(min(1 << 20, start + length - at))
                if not b:
                    raise ValueError("a record ends early")
                z.decompress(b)
                at += len(b) - len(z.unused_data)
            found.append((begin, at - begin))
    return found


def plan_records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """id, url, payload, digest, refers_to of each page; the payload of a revisit is there, for its length.

    Who refers to whom is decided on (id, digest) alone, and the payloads then meet that by id and digest: a
    payload that a third of the pages share is never gathered in one task.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    base = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    narrow, path = written(base.where(F.octet_length("payload") >= least).groupBy("id", "digest").agg(F.count("*").alias("n")), "digests")
    later(path)
    lead = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.sum("n").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    revisits = narrow.join(lead, "digest").where("not id <=> refers_to").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    joined = base.join(revisits.hint("shuffle_hash"), base["id"].eqNullSafe(revisits["_id"]) & (base["digest"] == revisits["_digest"]), "left")
    return joined.select("id", "url", "payload", F.lower(F.hex("digest")).alias("digest"), "refers_to")


def write_packages(planned: DataFrame, folder: str, package_bytes: int = 16 << 20) -> DataFrame:
    """Writes the packages under ``folder``; returns the manifest (path, size, records), written too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"  # a name of this attempt
            where, name = opened(path)
            where.create_dir(name.rpartition("/")[0], recursive=True)
            b = package(held)
            with where.open_output_stream(name) as f:
                f.write(b)
            return pa.record_batch([pa.array([path]), pa.array([len(b)], pa.int64()), pa.array([len(held)], pa.int64())], ["path", "size", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                raw = record(page, url, payload, digest, refers)
                held.append((f"{'null' if page is None else page} {digest}", raw))
                size += len(raw)
                if size >= package_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    manifest, path = written(planned.mapInArrow(lean(run), "path string, size long, records long"), "manifest")
    later(path)
    return manifest


def read_packages(manifest: DataFrame, with_payload: bool = True, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of the packages named in ``manifest``: path and, if known, size (bytes)."""
    schema = T.StructType.fromDDL(RECORD + (", payload binary" if with_payload else ""))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                cuts: list[list] = []
                try:
                    where, name = opened(path)
                    with where.open_input_file(name) as f:
                        found = sorted(locate(f, f.size()))
                    for offset, n in found:
                        last = cuts[-1] if cuts else None
                        if last and last[2] == offset and offset - last[0] < split_bytes:
                            last[1].append(n)
                            last[2] += n
                        else:
                            cuts.append([offset, [n], offset + n])
                    error = None
                except BROKEN as e:
                    cuts, error = [[None, [], None]], f"{type(e).__name__}: {e}"
                yield pa.record_batch(
                    [pa.array([path] * len(cuts), pa.string()), pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.list_(pa.int64())), pa.array([error] * len(cuts), pa.string())],
                    ["path", "offset", "lengths", "error"],
                )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, lengths, error in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "lengths", "error"))):
                rows, at = [], 0
                if error is not None:
                    rows.append(dict.fromkeys(FIELDS) | {"error": error})
                else:
                    where, name = opened(path)
                    with where.open_input_file(name) as f:
                        f.seek(offset)
                        b = memoryview(f.read(sum(lengths)))
                    for n in lengths:
                        try:
                            rows.append(parse(zlib.decompress(b[at : at + n], 31)))
                        except BROKEN as e:
                            rows.append(dict.fromkeys(FIELDS) | {"error": f"at {offset + at}: {type(e).__name__}: {e}"})
                        at += n
                        if not with_payload:
                            rows[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} | {"path": path} for r in rows], schema=_arrow(schema))

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "size" in manifest.columns:
        tasks = max(1, -(-(manifest.agg(F.sum("size")).first()[0] or 0) // split_bytes))
    cut = manifest.select("path").mapInArrow(lean(ranges), "path string, offset long, lengths array<long>, error string")
    return cut.repartition(tasks, "path", "offset").mapInArrow(lean(records), schema)  # adaptive execution keeps an explicit number


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def archive(pages: DataFrame, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to packages and reads them back. The packages stay in ``folder``; without one
    they are deleted when the process ends."""
    direct(pages.sparkSession)
    if folder is None:
        folder = new_path(pages.sparkSession, "warc")
        later(folder)
    small_batches(pages.sparkSession)
    planned = plan_records(pages)
    return read_packages(write_packages(planned, folder), with_payload)
