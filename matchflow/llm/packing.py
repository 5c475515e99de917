"""Token ids packed into rows of fixed length by best-fit decreasing, written as binary matrices.

A task gathers documents until a pool holds enough tokens, then packs the pool:
documents longer than a row are split, whole rows first and the rest as a piece
of its own, and the pieces go, longest first, to the row with the least room
that still holds them. A segment tree over the sizes of room finds that row.
Rows left open go back to the next pool of the task, so that only the last one
of a task can be badly filled. A pool's size bounds what a task holds.

Per task four files hold the rows: ``.ids`` (matrix of ids, padded), ``.cu``
(cumulative segment lengths, from 0), ``.index`` (for each row where its
lengths begin in .cu), and ``.resets`` (one bit for each cell, set where a
segment begins and positions start again from 0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.bpe import VOCABULARY, encoding_of, token_bytes_of
from matchflow.llm.common import ready, scratch, shared_uri, stored, table, whole_text

#: Tokens of a row and of a pool.
LENGTH, POOL_TOKENS = 2048, 2_000_000
#: A row that is filled to this share goes out; others wait for the next pool.
FILLED = 0.98


class Rooms:
    """Open rows by the room they have left; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and number of the fullest row that holds ``size`` more; it is no longer open."""
        node = size + self.leaves
        if not self.count[node]:
            # Up to the first ancestor with something to its right, then down to the left.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers. Pieces have 1 to ``length`` tokens; equal ones keep their order."""
    rooms, rows = Rooms(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[piece])
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > sizes[piece]:
            rooms.add(room - sizes[piece], row)
    return rows


@dataclass
class Piece:
    doc_id: int | None
    offset: int
    ids: np.ndarray


def split(doc_id: int | None, ids: np.ndarray, length: int) -> list[Piece]:
    return [Piece(doc_id, at, ids[at:at + length]) for at in range(0, len(ids), length)]


@dataclass
class Files:
    """The files of a task; they get their names when they are whole."""

    folder: str
    part: int
    attempt: int
    streams: dict = field(default_factory=dict)
    rows: int = 0
    lengths: int = 0

    def __post_init__(self) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(self.folder)

    def write(self, **blocks: bytes) -> None:
        for name, block in blocks.items():
            if name not in self.streams:
                self.fs.create_dir(self.root, recursive=True)
                self.streams[name] = self.fs.open_output_stream(f"{self.root}/_{self.part}-{self.attempt}.{name}")
            self.streams[name].write(block)

    def close(self) -> None:
        for name, stream in self.streams.items():
            stream.close()
            self.fs.move(f"{self.root}/_{self.part}-{self.attempt}.{name}", f"{self.root}/part-{self.part:06d}.{name}")


_ROWS = "part long, row long, n_tokens int, doc_ids array<bigint>, offsets array<int>, cu_seqlens array<int>, ids_sha256 string"


def _packer(folder: str, length: int, pool_tokens: int, path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files = Files(folder, context.partitionId(), context.taskAttemptId())
        encode = encoding_of(path).encode_ordinary
        pad = len(token_bytes_of(path))
        kind = "<u2" if pad < 1 << 16 else "<u4"
        pool: list[Piece] = []
        tokens = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal pool, tokens
            rows = [[pool[i] for i in row] for row in best_fit([len(p.ids) for p in pool], length)]
            used = [sum(len(p.ids) for p in r) for r in rows]
            wait = {i for i, n in enumerate(used) if n < FILLED * length}
            if last or sum(used[i] for i in wait) > pool_tokens // 2:  # pieces that fit no better go out as they are
                wait = set()
            full = [r for i, r in enumerate(rows) if i not in wait]
            pool = [p for i in sorted(wait) for p in rows[i]]
            tokens = sum(used[i] for i in wait)
            return _written(files, full, length, pad, kind) if full else None

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode(text), dtype=kind)
                pool += split(doc_id, ids, length)
                tokens += len(ids)
                if tokens >= pool_tokens:
                    out = flush(False)
                    if out is not None:
                        yield out
        out = flush(True)
        files.close()
        if out is not None:
            yield out

    return pack


def _written(files: Files, rows: list[list[Piece]], length: int, pad: int, kind: str) -> pa.RecordBatch:
    """Write rows of pieces, and tell what they hold."""
    matrix = np.full((len(rows), length), pad, dtype=kind)
    resets = np.zeros((len(rows), length), bool)
    cumulative = []
    for n, row in enumerate(rows):
        ends = np.concatenate([[0], np.cumsum([len(p.ids) for p in row])]).astype("<i4")
        for piece, start, end in zip(row, ends[:-1], ends[1:]):
            matrix[n, start:end] = piece.ids
            resets[n, start] = True
        cumulative.append(ends)
    heads = files.lengths + np.concatenate([[0], np.cumsum([len(c) for c in cumulative])])
    files.write(ids=matrix.tobytes(), cu=np.concatenate(cumulative).tobytes(),
                index=heads[:-1].astype("<i8").tobytes(), resets=np.packbits(resets, axis=1).tobytes())
    first, files.rows, files.lengths = files.rows, files.rows + len(rows), int(heads[-1])
    return pa.RecordBatch.from_pydict({
        "part": pa.array([files.part] * len(rows), pa.int64()), "row": pa.array(range(first, files.rows), pa.int64()),
        "n_tokens": pa.array([int(c[-1]) for c in cumulative], pa.int32()),
        "doc_ids": pa.array([[p.doc_id for p in r] for r in rows], pa.list_(pa.int64())),
        "offsets": pa.array([[p.offset for p in r] for r in rows], pa.list_(pa.int32())),
        "cu_seqlens": pa.array([c.tolist() for c in cumulative], pa.list_(pa.int32())),
        "ids_sha256": pa.array([hashlib.sha256(m.tobytes()).hexdigest() for m in matrix], pa.string()),
    })


def write_packed(
    documents: DataFrame, folder: str, length: int = LENGTH, pool_tokens: int = POOL_TOKENS, path: str | None = None
) -> DataFrame:
    """Pack the token ids of all whole texts into files in ``folder``; one row for each packed row.

    Returns part, row, n_tokens, and for its segments doc_ids, offsets (of the
    segment in its document's ids) and cu_seqlens, with the SHA-256 of the row's
    cells. Ids are 16 bits wide where the vocabulary allows, padding is the first
    id beyond it. Every id of every document lies in exactly one segment. Null
    and empty texts have no segment; rows that repeat are packed each; doc_id may
    be null; other columns are ignored; an empty table gives no file and no row.
    The list is stored, so reading it packs nothing again.
    """
    ready(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    path = path or public_tokenizers.path(VOCABULARY)
    return stored(rows.mapInArrow(_packer(folder, length, pool_tokens, path), _ROWS), "packed-rows")


def _unpacker(folder: str, length: int, path: str):
    kind = "<u2" if len(token_bytes_of(path)) < 1 << 16 else "<u4"
    width = length * np.dtype(kind).itemsize

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, row in zip(batch.column("part").to_pylist(), batch.column("row").to_pylist()):
                base = f"{root}/part-{part:06d}"

                def read(name: str, at: int, size: int) -> bytes:
                    with fs.open_input_file(f"{base}.{name}") as stream:
                        return stream.read_at(size, at)

                ids = np.frombuffer(read("ids", row * width, width), kind).astype("i4")
                resets = np.unpackbits(np.frombuffer(read("resets", row * (-(-length // 8)), -(-length // 8)), "u1"))[:length]
                head = np.frombuffer(read("index", row * 8, 16), "<i8")
                size = fs.get_file_info(f"{base}.cu").size
                stop = int(head[1]) * 4 if len(head) > 1 else size
                cumulative = np.frombuffer(read("cu", int(head[0]) * 4, stop - int(head[0]) * 4), "<i4")
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int64()), "row": pa.array([row], pa.int64()),
                    "segments": pa.array([[ids[a:b].tolist() for a, b in zip(cumulative[:-1], cumulative[1:])]], pa.list_(pa.list_(pa.int32()))),
                    "resets": pa.array([np.flatnonzero(resets).tolist()], pa.list_(pa.int32()))})

    return unpack


def read_packed(rows: DataFrame, folder: str, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Segments and resets of packed rows, read back from the files: part, row, segments, resets."""
    path = path or public_tokenizers.path(VOCABULARY)
    return rows.select("part", "row").mapInArrow(
        _unpacker(folder, length, path), "part long, row long, segments array<array<int>>, resets array<int>")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    folder = shared_uri(scratch(spark, "packed"))
    return write_packed(table(spark, sf_dir, "documents"), folder)


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
