import hashlib
import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwork.llm import warc

PAGE = "page_id long, url string, html string, digest string"


def test_round_trip_with_revisits(spark):
    big, other = "<p>é" + "x" * 2000, "y" * 999
    rows = [(1, "http://a/é b", big, "d"), (2, None, None, None), (3, "u", "", "d"), (4, "u", big, "d"), (9, "v", big, "d"), (9, "v", big, "d"), (5, "w", other, "d"), (6, "w", other, "d"), (None, "z", big, "d")]
    out = warc.archive(spark.createDataFrame(rows, PAGE), with_payload=True).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next(h or "" for i, _, h, _ in rows if i == r.page_id).encode()
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
        assert r.payload == (html if r.record_type == "response" else None) and r.error is None
        assert r.url in {u for i, u, _, _ in rows if i == r.page_id}
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in out if r.payload_bytes > 1000) == [(0, "revisit", 9), (1, "revisit", 9), (4, "revisit", 9), (9, "response", None), (9, "response", None)]
    assert all(r.record_type == "response" for r in out if r.payload_bytes < 1000)


def test_empty_table_and_hot_payload(spark):
    empty = spark.createDataFrame([], PAGE)
    assert warc.archive(empty).count() == 0
    hot = spark.range(500).selectExpr("id as page_id", "'u' as url", "case when id % 3 = 0 then repeat('h', 1500) else concat(repeat('k', 1200), id) end as html", "'x' as digest")
    out = warc.archive(hot)
    assert out.where("record_type = 'revisit' and refers_to = 498").count() == 166
    assert out.count() == 500 and out.where("record_type = 'response'").count() == 334


def records(n):
    return [(str(i), warc.record(i, "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None)) for i in range(n)]


def test_reader_needs_no_index_and_takes_comments():
    b = io.BytesIO()
    whole = warc.package(records(20))
    with zipfile.ZipFile(io.BytesIO(whole)) as z, zipfile.ZipFile(b, "w") as out:
        out.comment = b"PK\x05 a comment"
        out.writestr(warc.DATA, z.read(warc.DATA))
        out.writestr("packed.txt", "t" * 1000, zipfile.ZIP_DEFLATED)
    assert "packed.txt" not in warc.members(b, len(b.getvalue()))
    found = warc.locate(b, len(b.getvalue()))
    want = warc.locate(io.BytesIO(whole), len(whole))
    assert [n for _, n in found] == [n for _, n in want] and len(found) == 20


def test_zip64_directory():
    plain = warc.package(records(3))
    end = plain.rfind(b"PK\x05\x06")
    count, length, offset = struct.unpack("<HII", plain[end + 10 : end + 20])
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    b = plain[:end] + wide + locator + tail
    assert warc.locate(io.BytesIO(b), len(b)) == warc.locate(io.BytesIO(plain), len(plain))


def test_broken_files_are_errors():
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no zip"), 6)
    raw = records(2)[1][1].replace(b"\r\n\r\np\r\n", b"\r\n\r\nq\r\n")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw)


def test_damaged_packages_and_records_are_rows(spark, tmp_path):
    whole = warc.package(records(20))
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        data = whole.index(z.read(warc.DATA))
        spot = [int(x.split()[1]) for x in z.read(warc.INDEX).decode().splitlines()]
    broken = bytearray(whole)
    broken[data + spot[7] + 20] ^= 255
    files = {"whole": whole, "broken": bytes(broken), "cut": whole[:-30], "none": b""}
    for name, b in files.items():
        (tmp_path / name).write_bytes(b)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in [*files, "missing"]], "path string")
    out = warc.read_packages(manifest).collect()
    by = {n: [r for r in out if r.path.endswith("/" + n)] for n in [*files, "missing"]}
    assert len(by["whole"]) == len(by["broken"]) == 20 and not any(r.error for r in by["whole"])
    assert [r.page_id for r in by["broken"] if r.error] == [None] and {r.page_id for r in by["broken"]} == {None, *range(20)} - {7}
    assert all(len(by[n]) == 1 and by[n][0].error for n in ("cut", "none", "missing"))


def test_any_changed_byte_gives_rows(spark, tmp_path):
    r = random.Random(2)
    whole = warc.package(records(5))
    for k in range(300):
        x = bytearray(whole)
        x[r.randrange(len(x)) if k % 2 else r.randrange(len(x) - 400, len(x))] = r.randrange(256)
        (tmp_path / str(k)).write_bytes(x)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{k}",) for k in range(300)], "path string")
    out = warc.read_packages(manifest, with_payload=False)
    assert out.where("error is not null").count() > 20 and out.where("error is null").count() > 500


def test_ranges_are_read_by_many_tasks(spark):
    pages = spark.range(300).selectExpr("id as page_id", "'u' as url", "concat(repeat(cast(uuid() as string), 50), id) as html")
    manifest = warc.write_packages(warc.plan_records(warc.written(pages, "pages")[0]), warc.new_path(spark, "warc"), package_bytes=100_000)
    read = warc.read_packages(manifest, split_bytes=20_000)
    assert read.count() == 300
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 2


def test_other_record_types(spark):
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:y>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    r = warc.parse(info)
    assert (r["record_type"], r["payload"], r["page_id"], r["date"]) == ("warcinfo", b"abc", None, None)
