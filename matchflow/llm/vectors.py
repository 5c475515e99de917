"""Helpers for operators on vectors: matrices from Arrow, groups of bounded size, runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` doubles; shorter vectors end in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def width_of(rows: DataFrame, vector: str = "vector") -> int:
    """Length of the longest vector, 0 without rows."""
    return rows.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0


def in_pieces(group: Column | str, rows: Column | str, most: int) -> Column:
    """Piece of a group of ``rows`` rows, none with many more than ``most``.

    The piece follows from ``row_no``, not from the row's content: rows that
    repeat a third of the table spread as evenly as others.
    """
    pieces = F.ceil(F.col(rows) / most) if isinstance(rows, str) else F.ceil(rows / most)
    own = F.col(group) if isinstance(group, str) else group
    return F.pmod(F.xxhash64(own, "row_no"), F.greatest(pieces, F.lit(1))).cast("int")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted rows as slices of equal key; a key that spans batches comes in several slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield tuple(c[at].item() for c in columns), batch.slice(at, end - at)
