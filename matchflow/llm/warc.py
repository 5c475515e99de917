"""WARC archives: deduplicated writing, and a reader that splits gzip files.

Every record is a gzip member of its own. A reading task gets a byte range of a
file, looks for the gzip magic in it, checks each candidate by decoding its
header and then the whole member (its length and CRC are part of the format),
and owns the records that start inside its range; it reads past the end of the
range to finish its last record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import ready, scratch, shared_uri, stored, table, whole_text

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file that one reading task looks through.
SPLIT_BYTES = 16 << 20
#: Bytes read or decoded at a time.
STEP = 1 << 20
#: A record's header fields end within so many decoded bytes.
HEADER_BYTES = 1 << 20


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields)])
    head += f"Content-Length: {len(block)}\r\n\r\n".encode()
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _clean(value: str) -> str:
    """A header value keeps to its line."""
    return " ".join(value.split())


def _writer(folder: str, now: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        out, size, rows = None, 0, 0
        temporary, final = f"{root}/_attempt-{part}-{attempt}", f"{root}/part-{part:06d}.warc.gz"
        for batch in batches:
            for page, url, payload, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary)
                block = (payload or "").encode("utf-8", "surrogatepass")
                fields = [
                    ("WARC-Type", "response" if first is None else "revisit"),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{url}')}>"),
                    ("WARC-Date", now), ("WARC-Target-URI", _clean(url or "")),
                    ("WARC-Payload-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "text/html"),
                    ("X-Page-ID", "" if page is None else str(page)), ("X-Payload-Length", str(len(block))),
                ]
                if first is not None:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", _clean(first_url or "")),
                               ("X-Refers-To-Page-ID", str(first))]
                    block = b""
                member = record(fields, block)
                out.write(member)
                size, rows = size + len(member), rows + 1
        if out is not None:
            out.close()
            fs.move(temporary, final)  # a task that runs again replaces the file by the same bytes
            scheme = folder.split("://")[0] + "://" if "://" in folder else ""
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([scheme + final]), "size": pa.array([size], pa.int64()), "records": pa.array([rows], pa.int64())})

    return write


def _payload_digest() -> list:
    return [F.sha1(F.encode("html", "utf-8")).alias("digest"), F.octet_length("html").cast("long").alias("bytes")]


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages whose payload an earlier page has: page_id, digest, bytes, first_id, first_url."""
    own = pages.select("page_id", "url", *_payload_digest()).filter(
        (F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = own.groupBy("digest", "bytes").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")
    ).filter("copies > 1")
    both = own.join(firsts, ["digest", "bytes"]).filter(F.col("page_id") != F.col("first.page_id"))
    return both.select(
        "page_id", "digest", "bytes", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")
    ).distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write one record per row of (page_id, url, html); returns path, size, records of the files.

    The payload is the html in UTF-8, null counts as empty. Of rows with equal
    payloads of at least ``least_bytes`` bytes the smallest page_id is a
    response and the others are revisits, which refer to it and have no block.
    Rows that repeat a page_id and payload are written alike; rows without
    page_id are responses. The list of files is stored with them, so reading it
    writes nothing again. Files appear under their name when they are whole.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        whole_text("html").alias("html"))
    repeated = revisits(rows, least_bytes)
    marked = rows.select("*", *_payload_digest()).join(repeated, ["page_id", "digest", "bytes"], "left").select("page_id", "url", "html", "first_id", "first_url")
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    files = marked.mapInArrow(_writer(folder, now), "path string, size long, records long")
    return stored(files, "warc-files")


class Source:
    """Bytes of a file from any position, read in steps and held only as far as they are needed."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.start, self.held = stream, size, 0, b""

    def at(self, start: int, length: int) -> bytes:
        """At most ``length`` bytes from ``start`` on."""
        length = min(length, self.size - start)
        if length <= 0:
            return b""
        if not (self.start <= start and start + length <= self.start + len(self.held)):
            keep = self.held[start - self.start:] if self.start <= start <= self.start + len(self.held) else b""
            self.stream.seek(start + len(keep))
            self.start, self.held = start, keep + self.stream.read(max(length, STEP) - len(keep))
        return self.held[start - self.start:start - self.start + length]


def _member(source: Source, start: int) -> tuple[bytes, int] | None:
    """What a gzip member at ``start`` holds and where it ends; None if there is no record there."""
    unpack, out, at, checked = zlib.decompressobj(31), io.BytesIO(), start, False
    while not unpack.eof:
        data = source.at(at, STEP)
        if not data:
            return None
        try:
            while data and not unpack.eof:
                piece = unpack.decompress(data, STEP)
                out.write(piece)
                data_left = unpack.unconsumed_tail if not unpack.eof else unpack.unused_data
                at += len(data) - len(data_left)
                data = data_left if not unpack.eof else b""
                if not checked and (out.tell() >= len(VERSION) or unpack.eof):
                    head = out.getvalue()
                    if not head.startswith(VERSION[:5]):
                        return None
                    if b"\r\n\r\n" in head[:HEADER_BYTES]:
                        checked = True
                    elif len(head) >= HEADER_BYTES:
                        return None
        except zlib.error:
            return None
    return (out.getvalue(), at) if checked else None


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields and block of a record; None where its lengths do not agree."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(VERSION[:5]):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[int(length):] != b"\r\n\r\n":
        return None
    return fields, rest[:int(length)]


def records_in(source: Source, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and block of the records that start in [start, stop)."""
    at = start
    while at < stop:
        window = source.at(at, min(STEP, stop - at + len(MAGIC) - 1))
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= stop:
            return
        member = _member(source, at)
        parsed = parse(member[0]) if member else None
        if parsed is None:
            at += 1
            continue
        yield at, *parsed
        at = member[1]


_READ = "path string, offset long, type string, record_id string, uri string, digest string, fields map<string,string>, block binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields_type = pa.map_(pa.string(), pa.string())
    for batch in batches:
        for path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
            with fs.open_input_file(place) as stream:
                for offset, fields, block in records_in(Source(stream, size), start, stop):
                    yield pa.RecordBatch.from_pydict({
                        "path": pa.array([path]), "offset": pa.array([offset], pa.int64()),
                        "type": pa.array([fields.get("warc-type")], pa.string()),
                        "record_id": pa.array([fields.get("warc-record-id")], pa.string()),
                        "uri": pa.array([fields.get("warc-target-uri")], pa.string()),
                        "digest": pa.array([fields.get("warc-payload-digest")], pa.string()),
                        "fields": pa.array([list(fields.items())], fields_type), "block": pa.array([block], pa.binary()),
                    })


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of gzip files given as (path, size); tasks read byte ranges of at most ``split_bytes``.

    Returns path, offset, type, record_id, uri, digest, fields (names in lower
    case), block. Bytes that are no valid record are passed over. Files of size
    0 and null paths give no row.
    """
    ready(files.sparkSession)
    ranges = files.filter("path is not null and size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ).select("path", "size", "start", F.least("size", F.col("start") + split_bytes).alias("stop"))
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(width, "path", "start").mapInArrow(_reader, _READ)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as archives into the shared folder, read back."""
    folder = shared_uri(scratch(spark, "warc"))
    return read_archives(write_archives(pages, folder, least_bytes))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """What the archives say of every page."""
    back = round_trip(spark, table(spark, sf_dir, "pages"))
    field = lambda name: F.col("fields")[name]
    return back.select(
        field("x-page-id").cast("long").alias("page_id"), field("x-payload-length").cast("long").alias("payload_bytes"),
        F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), F.col("type").alias("record_type"),
        field("x-refers-to-page-id").cast("long").alias("refers_to"),
    )


QUERIES = {"op5_warc": op5_warc}
ORACLE: dict[str, str] = {}
