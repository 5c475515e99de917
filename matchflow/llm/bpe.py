"""Byte-level BPE by one shuffle of distinct words.

A task cuts texts into pre-tokens. It takes documents in chunks of bounded
size, keeps for each chunk the sequence of word numbers in order of position,
and sends each distinct word of the chunk on once, dealt by the word's hash.
There every distinct word of the corpus is encoded once, in one place, however
many chunks hold it. The ids go back to the chunks, where documents are put
together by position. Word lists and sequences travel as packed bytes.

Decoding joins ids with the byte strings of the vocabulary, whose size is fixed
by the rank file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import give_back, ready, remembered, scratch, slices_of, table, tidy, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk: what a task holds decoded at a time. One longer text is a chunk by itself.
CHUNK_CHARS = 4_000_000
#: Distinct words that a task keeps encoded before it starts its memory anew.
MEMORY_WORDS = 200_000

_SCHEMA = "chunk long, slice int, keys binary, body binary"
_WITH_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


@remembered
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@remembered
def encoding_of(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


@remembered
def token_bytes_of(path: str) -> list[bytes]:
    """The token-byte table: byte string of each id."""
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@remembered
def digits_of(path: str) -> list[bytes]:
    return [b"%d" % i for i in range(len(token_bytes_of(path)))]


_find = regex.compile(public_tokenizers.PATTERN).findall


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_ints(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes; frequent words have small numbers, so most planes are empty."""
    return _pack(np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())


def _unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype("i8")


class _Numbers(dict):
    """Numbers new keys in order of arrival."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _spread(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each width, one run after the other."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - widths - starts, widths)


class _Chunk:
    """Documents as sequences of pre-token numbers."""

    def __init__(self) -> None:
        self.numbers, self.keys, self.runs, self.chars = _Numbers(), [], [], 0

    def add(self, key: int, text: str) -> None:
        self.keys.append(key)
        self.chars += len(text)
        self.runs.append(np.fromiter(map(self.numbers.__getitem__, _find(text)), "<i4"))

    def rows(self, me: int, slices: int) -> Iterator[tuple]:
        """One row of sequences (slice -1), then one row of words for each slice that has some."""
        words = [w.encode("utf-8") for w in self.numbers]
        dealt = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % slices
        sequence = np.concatenate(self.runs)
        rank = np.empty(len(words), "i8")
        falling = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
        rank[falling] = np.arange(len(words))
        by = sorted(range(len(words)), key=list(zip(dealt.tolist(), words)).__getitem__)
        place = np.empty(len(words), "i8")  # of each word in the rows by slice
        place[by] = np.arange(len(words))
        lengths = np.array([len(r) for r in self.runs])
        sink = pa.BufferOutputStream()
        heads = pa.RecordBatch.from_pydict({"doc_id": pa.array(self.keys, pa.int64()), "n": pa.array(lengths, pa.int64())})
        with pa.ipc.new_stream(sink, heads.schema) as out:
            out.write_batch(heads)
        parts = [sink.getvalue().to_pybytes(), _pack_ints(place[falling]), _pack_ints(rank[sequence])]
        yield me, -1, np.array([len(p) for p in parts], "<i8").tobytes(), b"".join(parts)
        edges = np.searchsorted(dealt[by], np.arange(slices + 1))
        for s in range(slices):
            if edges[s] < edges[s + 1]:
                own = [words[i] for i in by[edges[s]:edges[s + 1]]]
                sizes = np.array([len(w) for w in own], "<i4")
                yield me, s, np.array([edges[s], len(own)], "<i4").tobytes(), _pack(sizes.tobytes() + b"".join(own))


def _splitter(slices: int):
    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk.keys and chunk.chars + len(text) > CHUNK_CHARS:
                    for row in chunk.rows((part << 33) + number, slices):
                        yield _row(*row)
                    chunk, number = _Chunk(), number + 1
                chunk.add(key, text)
        if chunk.keys:
            for row in chunk.rows((part << 33) + number, slices):
                yield _row(*row)

    return split


def _row(chunk: int, part: int, keys: bytes, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "chunk": pa.array([chunk], pa.int64()), "slice": pa.array([part], pa.int32()),
        "keys": pa.array([keys], pa.binary()), "body": pa.array([body], pa.binary()),
    })


def _encoder(path: str):
    """Rows of words in, the same rows with ids out; a word met before is not encoded again."""

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = encoding_of(path)._core_bpe.encode_single_piece
        ranks = ranks_of(path)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for chunk, part, keys, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw, n = _unpack(body), int(np.frombuffer(keys, "<i4")[1])
                at, out = 4 * n, []
                for size in np.frombuffer(raw, "<i4", n).tolist():
                    word = raw[at:at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= MEMORY_WORDS:
                            known.clear()
                        whole = ranks.get(word)
                        known[word] = ids = np.array([whole] if whole is not None else merge(word), "<i4").tobytes()
                    out.append(ids)
                sizes = np.array([len(i) >> 2 for i in out], "<i4")
                yield _row(chunk, part, keys, _pack(sizes.tobytes() + b"".join(out)))

    return encode


def _assembled(chunk: pa.Table, encoded: pa.Table) -> pa.Table:
    """A chunk's sequences and the ids of its words in, its documents with their ids out."""
    sizes = np.frombuffer(chunk.column("keys")[0].as_py(), "<i8")
    head, places, sequence = _parts(chunk.column("body")[0].as_py(), sizes)
    documents = pa.ipc.open_stream(head).read_all()
    place, sequence = _unpack_ints(places), _unpack_ints(sequence)
    pools = []
    for keys, body in zip(encoded.column("keys").to_pylist(), encoded.column("body").to_pylist()):
        first, n = np.frombuffer(keys, "<i4").tolist()
        raw = np.frombuffer(_unpack(body), "<i4")
        pools.append((first, raw[:n], raw[n:]))
    pools.sort(key=lambda p: p[0])
    width = np.concatenate([np.zeros(0, "i8"), *(p[1] for p in pools)]).astype("i8")
    ids = np.concatenate([np.zeros(0, "<i4"), *(p[2] for p in pools)])
    start = np.cumsum(width) - width
    own = place[sequence]
    flat = ids[_spread(start[own], width[own])]
    ends = np.concatenate([[0], np.cumsum(width[own])])
    offsets = ends[np.concatenate([[0], np.cumsum(documents.column("n").to_numpy())])]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int32()))
    return pa.table({"doc_id": documents.column("doc_id"), "ids": lists.cast(pa.list_(pa.int32()))})


def _parts(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _assembled_with_digests(path: str):
    """As _assembled, with the columns of ``digests``: ids meet their digests in the worker that made them."""

    def assemble(chunk: pa.Table, encoded: pa.Table) -> pa.Table:
        try:
            out = []
            for batch in _assembled(chunk, encoded).to_batches():
                out.append(_digested(batch, path).append_column("ids", batch.column(1)))
            return pa.Table.from_batches(out)
        finally:
            give_back()

    return assemble


def encode(documents: DataFrame, path: str | None = None, text: str = "text", digested: bool = False) -> DataFrame:
    """Token ids of every whole text: doc_id, ids array<int>, without special tokens.

    Null and empty texts have no ids. Rows are never merged: equal rows and rows
    without doc_id give a row each. Other columns are left out, whatever their
    names. An empty table gives no row. With ``digested`` the result is that of
    ``with_digests``, by one Python worker for each task instead of two.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ready(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    slices = slices_of(rows)
    # Bucketed by chunk: the sequences stay where they are until the ids come to them.
    spark = documents.sparkSession
    name = f"bpe_{uuid.uuid4().hex}"
    dealt = rows.mapInArrow(_splitter(slices), _SCHEMA).withColumn("words", F.col("slice") >= 0)
    (
        dealt.write.partitionBy("words").bucketBy(slices, "chunk").option("compression", "uncompressed")
        .option("path", scratch(spark, name)).saveAsTable(name)
    )
    kept = spark.table(name).select("chunk", "slice", "keys", "body", "words")
    words = kept.filter("words").drop("words").repartition(slices, "slice").mapInArrow(_encoder(path), _SCHEMA)
    chunks = kept.filter("not words").drop("words")
    both = chunks.groupBy("chunk").cogroup(words.groupBy("chunk"))
    if digested:
        return both.applyInArrow(_assembled_with_digests(path), _WITH_DIGESTS)
    return both.applyInArrow(_assembled, "doc_id long, ids array<int>")


def _decoder(path: str):
    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = token_bytes_of(path).__getitem__
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy()
            content = [b"".join(map(joined, flat[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(content, pa.binary())], names=["doc_id", "ids", "bytes"])

    return decode


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``bytes``, the byte strings of the ids one after the other."""
    path = path or public_tokenizers.path(VOCABULARY)
    ready(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoder(path), "doc_id long, ids array<int>, bytes binary")


def _digested(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    digit, joined = digits_of(path).__getitem__, token_bytes_of(path).__getitem__
    offsets = batch.column(1).offsets.to_numpy()
    flat = batch.column(1).values.to_numpy()
    counts, of_ids, of_bytes = [], [], []
    for a, b in zip(offsets[:-1], offsets[1:]):
        ids = flat[a:b].tolist()
        counts.append(len(ids))
        of_ids.append(hashlib.sha256(b",".join(map(digit, ids))).hexdigest())
        of_bytes.append(hashlib.sha256(b"".join(map(joined, ids))).hexdigest())
    return pa.RecordBatch.from_pydict({
        "doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
        "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string()),
    })


def _digester(path: str):
    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digested(batch, path)

    return digest


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    return encoded.select("doc_id", "ids").mapInArrow(
        _digester(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Encoded documents with the columns of ``digests`` beside their ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    @tidy
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digested(batch, path).append_column("ids", batch.column(1))

    return encoded.select("doc_id", "ids").mapInArrow(both, _WITH_DIGESTS)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE: dict[str, str] = {}
