"""Archives give every page back, however the reader splits them."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from matchflow.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}\r\nX: y", f"<p>{'é' * (i % 7)} page {i % 9}</p>" * (i + 1)) for i in range(40)]
    rows += [(100, "u", None), (101, None, ""), (102, "u", "same"), (50, "u", "same"), (103, "u", "same"),
             (104, "u", "WARC/1.1\r\n\r\n"), (105, "u", "z" * 300_000), (106, "u", "\x1f\u008b\x08 not gzip")]
    return rows


def expected(rows, least=0):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        revisit = first[html or ""] != page and len(payload) >= least
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out)


def summary(frame):
    rows = frame.select(
        F.col("fields")["x-page-id"].cast("long"), F.col("fields")["x-payload-length"].cast("long"),
        F.regexp_replace("digest", "^sha1:", ""), "type", F.col("fields")["x-refers-to-page-id"].cast("long")).collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, pages, least):
    frame = spark.createDataFrame(pages, PAGES).repartition(3).withColumn("digest", F.lit("clash"))
    back = warc.round_trip(spark, frame, least)
    assert summary(back) == expected(pages, least)
    blocks = {int(r["fields"]["x-page-id"]): bytes(r["block"]) for r in back.filter("type = 'response'").collect()}
    html = {p: (h or "").encode() for p, _, h in pages}
    assert all(block == html[page] for page, block in blocks.items())


def test_every_split_gives_each_record_once(spark, pages):
    folder = warc.shared_uri(warc.scratch(spark, "warc-test"))
    files = warc.write_archives(spark.createDataFrame(pages, PAGES).coalesce(1), folder)
    whole = summary(warc.read_archives(files))
    assert warc.read_archives(files, split_bytes=701).count() == len(pages)
    assert summary(warc.read_archives(files, split_bytes=701)) == whole


def archive(*members):
    data = b"".join(members)
    return warc.Source(io.BytesIO(data), len(data)), len(data)


def test_records_are_owned_by_the_range_they_start_in():
    one = warc.record([("WARC-Type", "response"), ("X", "1")], b"a" * 50)
    two = warc.record([("WARC-Type", "response"), ("X", "2")], b"b" * 5000)
    cut = len(one)
    for limit in range(1, cut + len(two) + 1):
        source, size = archive(one, two)
        left = [f["x"] for _, f, _ in warc.records_in(source, 0, limit)]
        right = [f["x"] for _, f, _ in warc.records_in(source, limit, size)]
        assert left + right == ["1", "2"], limit
        assert len(left) == (1 if limit <= cut else 2)


def test_magic_that_starts_no_record_is_passed_over():
    real = warc.record([("WARC-Type", "resource")], b"x")
    other = gzip.compress(b"no record at all")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # holds a whole member in plain sight
    head = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(real)
    outer = stored.compress(head + real + b"\r\n\r\n") + stored.flush()
    broken = bytearray(real)
    broken[-6] ^= 255
    source, size = archive(b"\x1f\x8b\x08junk", other, bytes(broken), real, outer, real[:-9])
    found = [(fields.get("warc-type"), block) for _, fields, block in warc.records_in(source, 0, size)]
    assert found == [("resource", b"x"), (None, real)]


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", "same"), (3, "u", "same"), (3, "u", "same"), (5, "u", "same"), (5, "u", "other"), (4, "u", "other")]
    back = warc.round_trip(spark, spark.createDataFrame(rows, PAGES)).collect()
    got = sorted(((r["fields"]["x-page-id"], r["type"], r["fields"].get("x-refers-to-page-id")) for r in back), key=str)
    assert got == sorted([("", "response", None), ("3", "response", None), ("3", "response", None), ("5", "revisit", "3"),
                          ("5", "revisit", "4"), ("4", "response", None)], key=str)


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0
