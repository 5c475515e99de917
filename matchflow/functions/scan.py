"""Folds along an order that no single hot key can choke.

Some operators need more than a running sum: what happens at a row depends on
a state that all earlier rows have formed. Each key is cut into chunks, as in
``running``. A pass over the chunks sums each of them up, a fold over the
summaries of a key (one row per chunk) gives every chunk the state it starts
from, and a second pass works through the chunks side by side.

Chunks are handed to functions as Arrow tables in order, one at a time. A
summary and a carry are bytes of the operator's own making; they must not grow
with the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "_chunk"
_KIND, _CARRY = "_kind", "_carry"
#: Rows of results that go back together.
_TOGETHER = 5_000
#: (rows of a chunk, carry or None) -> rows out
Work = Callable[[pa.Table, bytes | None], pa.Table]


def _field(name: str, kind: str) -> str:
    return f"`{name}` {kind}"


def _starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where a new key begins."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for k in keys:
        now, before = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null()))
        change[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(change).tolist()


def _slices(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Sorted rows, key by key."""
    at, held = None, []
    for batch in batches:
        starts = _starts(batch, keys)
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append(batch.slice(start, end - start))
    if held:
        yield at, held


def _table(held: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(held).combine_chunks()


def chunked(df: DataFrame, chunk: Column) -> DataFrame:
    """Rows with the chunk they lie in; it must not fall along the order."""
    return df.withColumn(CHUNK, chunk.cast("long"))


def per_chunk(
    df: DataFrame, keys: list[str], order: list[str], work: Work, schema: str, carries: DataFrame | None = None
) -> DataFrame:
    """``work`` on the rows of every chunk, and on what is carried into it.

    ``schema`` names what it returns besides the keys and the chunk. Results of
    small chunks go back together, some thousand rows at a time.
    """
    keyed = [*keys, CHUNK]
    rows = df.withColumns({_KIND: F.lit(1), _CARRY: F.lit(None).cast("binary")})
    if carries is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in keyed]
        rows = rows.unionByName(carries.select(*keyed, F.lit(0).alias(_KIND), _CARRY, *blank))
    kinds = dict(df.dtypes)

    def together(found: list[tuple[tuple, pa.Table]], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables([out for _, out in found]).combine_chunks()
        place = pa.array(np.repeat(np.arange(len(found)), [out.num_rows for _, out in found]))
        for i, name in enumerate(keyed):
            one = pa.array([key[i] for key, _ in found], fields.field(name).type)
            whole = whole.add_column(i, name, one.take(place))
        yield from whole.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, fields = [], 0, None
        for key, held in _slices(batches, keyed):
            whole = _table(held)
            fields = whole.schema
            first = whole.column(_KIND)[0].as_py() == 0
            carry = whole.column(_CARRY)[0].as_py() if first else None
            own = (whole.slice(1) if first else whole).drop_columns([_KIND, _CARRY])
            if not own.num_rows:
                continue
            out = work(own, carry)
            found.append((key, out))
            n += out.num_rows
            if n >= _TOGETHER or len(found) >= _TOGETHER:
                yield from together(found, fields)
                found, n = [], 0
        if found:
            yield from together(found, fields)

    spread = rows.repartition(*keyed).sortWithinPartitions(*keyed, _KIND, *order)
    return spread.mapInArrow(run, ", ".join([*(_field(k, kinds[k]) for k in keyed), schema]))


def summed_up(df: DataFrame, keys: list[str], order: list[str], summary: Callable[[pa.Table, bytes | None], bytes],
              carries: DataFrame | None = None) -> DataFrame:
    """One row per chunk with its summary, and with what is carried into it if that is given."""

    def work(rows: pa.Table, carry: bytes | None) -> pa.Table:
        return pa.table({"summary": pa.array([summary(rows, carry)], pa.binary()), _CARRY: pa.array([carry], pa.binary())})

    return per_chunk(df, keys, order, work, f"summary binary, {_CARRY} binary", carries)


def carried(summaries: DataFrame, keys: list[str], step: Callable[[bytes | None, bytes, bytes | None], tuple]) -> DataFrame:
    """What each chunk starts from.

    ``step(state, summary, carry)`` gets the state before the chunk (None before
    the first) and answers with what the chunk is to know and the state after it.
    """
    kinds = dict(summaries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in keys]
            told = []
            for key, summary, carry in zip(zip(*names), batch.column("summary").to_pylist(),
                                           batch.column(_CARRY).to_pylist()):
                if key != at:
                    at, state = key, None
                known, state = step(state, summary, carry)
                told.append(known)
            columns = [batch.column(k) for k in [*keys, CHUNK]] + [pa.array(told, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, CHUNK, _CARRY])

    ordered = summaries.repartition(*keys).sortWithinPartitions(*keys, CHUNK)
    fields = [*(_field(k, kinds[k]) for k in [*keys, CHUNK]), f"{_CARRY} binary"]
    return ordered.mapInArrow(run, ", ".join(fields))
