"""Running and sliding aggregates that no single hot key can choke.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here
each key is cut into *chunks*: a column that never decreases along the order
(``seq_no div 50000``, a time slot, a value band). Rows are shuffled by
``(keys, chunk)``, the window runs inside the chunk, and what earlier chunks
contribute comes from a table with one row per chunk. Only that table is ever
ordered by the whole key. Results equal those of the plain window.

Keys must not be null (validated events never have null keys).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.functions.joins import join_null_safe

CHUNK_ROWS = 50_000
_CHUNK = "__chunk"
_FIRST = Window.unboundedPreceding


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column
    marker: Column | None = None
    prior: bool = False


def row_number() -> Running:
    return Running("total", F.lit(1).cast("long"))


def total(value: Column, prior: bool = False) -> Running:
    """Sum up to the row (``prior``: up to the row before), 0 over nothing."""
    return Running("total", value, prior=prior)


def whole(value: Column) -> Running:
    """Sum over all rows of the key."""
    return Running("whole", value)


def highest(value: Column, prior: bool = False) -> Running:
    return Running("highest", value, prior=prior)


def latest(value: Column, prior: bool = False) -> Running:
    """Last non-null value up to the row."""
    return Running("latest", value, prior=prior)


def earliest(value: Column) -> Running:
    """First non-null value up to the row."""
    return Running("earliest", value)


def previous(value: Column) -> Running:
    """Value of the row before, nulls included."""
    return Running("previous", F.struct(value.alias("v")), prior=True)


def since(value: Column, marker: Column) -> Running:
    """Sum of a non-negative value since the last marker row (or the start)."""
    return Running("since", value, marker)


def highest_since(value: Column, marker: Column) -> Running:
    """Maximum since the last marker row, that row's own value included."""
    return Running("highest_since", value, marker)


def excess(value: Column) -> Running:
    """``e = max(0, e_before + value)`` starting from 0 at the first row.

    In closed form this is the running sum minus its lowest point so far.
    """
    return Running("excess", value)


@dataclass
class _Parts:
    """Columns of one request, layer by layer."""

    local: list[list[tuple[str, Column]]]
    tail: list[tuple[str, Column]]  # aggregates of a chunk
    carry: list[list[tuple[str, Column]]]
    result: Column
    end: list[tuple[str, Column]] = field(default_factory=list)  # the same, read off the chunk's last row


_ORDERED = ("since", "highest_since", "excess")


def _parts(name: str, spec: Running, order: list[str], inside, chunks) -> _Parts:
    upto = inside.rowsBetween(_FIRST, 0)
    frame = inside.rowsBetween(_FIRST, -1) if spec.prior else upto
    before = chunks.rowsBetween(_FIRST, -1)
    everything = chunks.rowsBetween(_FIRST, Window.unboundedFollowing)
    v, along = spec.value, F.struct(*order)
    loc, tail, carry = (f"__{part}_{name}" for part in ("l", "t", "c"))
    loc2, tail2, carry2 = loc + "2", tail + "2", carry + "2"

    if spec.kind == "total":
        return _Parts(
            [[(loc, F.coalesce(F.sum(v).over(frame), F.lit(0)))]],
            [(tail, F.sum(v))],
            [[(carry, F.coalesce(F.sum(tail).over(before), F.lit(0)))]],
            F.col(loc) + F.col(carry),
            [(tail, F.sum(v).over(upto) if spec.prior else F.col(loc))],
        )
    if spec.kind == "whole":
        return _Parts([], [(tail, F.sum(v))], [[(carry, F.sum(tail).over(everything))]], F.col(carry),
                      [(tail, F.sum(v).over(upto))])
    if spec.kind == "highest":
        return _Parts(
            [[(loc, F.max(v).over(frame))]],
            [(tail, F.max(v))],
            [[(carry, F.max(tail).over(before))]],
            F.greatest(loc, carry),
            [(tail, F.max(v).over(upto) if spec.prior else F.col(loc))],
        )
    if spec.kind in ("latest", "previous"):
        out = F.coalesce(loc, carry)
        return _Parts(
            [[(loc, F.last(v, ignorenulls=True).over(frame))]],
            [(tail, F.max_by(v, F.when(v.isNotNull(), along)))],
            [[(carry, F.last(tail, ignorenulls=True).over(before))]],
            out["v"] if spec.kind == "previous" else out,
            [(tail, F.last(v, ignorenulls=True).over(upto) if spec.prior else F.col(loc))],
        )
    if spec.kind == "earliest":
        return _Parts(
            [[(loc, F.first(v, ignorenulls=True).over(upto))]],
            [(tail, F.min_by(v, F.when(v.isNotNull(), along)))],
            [[(carry, F.first(tail, ignorenulls=True).over(before))]],
            F.coalesce(carry, loc),
            [(tail, F.col(loc))],
        )
    if spec.kind == "since":
        return _Parts(
            [
                [(loc, F.sum(v).over(upto))],
                [(loc2, F.max(F.when(spec.marker, F.col(loc))).over(upto))],
            ],
            [(tail, F.col(loc)), (tail2, F.col(loc2))],
            [
                [(carry, F.coalesce(F.sum(tail).over(before), F.lit(0)))],
                [(carry2, F.coalesce(F.max(F.col(carry) + F.col(tail2)).over(before), F.lit(0)))],
            ],
            F.when(F.col(loc2).isNotNull(), F.col(loc) - F.col(loc2)).otherwise(
                F.col(carry) - F.col(carry2) + F.col(loc)
            ),
        )
    if spec.kind == "highest_since":
        pair = F.struct(F.col(loc).alias("segment"), v.alias("v"))
        shifted = F.struct(
            (F.col(carry) + F.col(tail2)["segment"]).alias("segment"), F.col(tail2)["v"].alias("v")
        )
        return _Parts(
            [
                [(loc, F.sum(F.when(spec.marker, 1).otherwise(0)).over(upto))],
                [(loc2, F.max(pair).over(upto))],
            ],
            [(tail, F.col(loc)), (tail2, F.col(loc2))],
            [
                [(carry, F.coalesce(F.sum(tail).over(before), F.lit(0)))],
                [(carry2, F.max(shifted).over(before))],
            ],
            F.when(F.col(loc) == 0, F.greatest(F.col(loc2)["v"], F.col(carry2)["v"])).otherwise(F.col(loc2)["v"]),
        )
    if spec.kind == "excess":
        lowest = F.least(F.col(carry2), F.col(carry) + F.col(loc2))
        return _Parts(
            [[(loc, F.sum(v).over(upto))], [(loc2, F.min(loc).over(upto))]],
            [(tail, F.col(loc)), (tail2, F.col(loc2))],
            [
                [(carry, F.coalesce(F.sum(tail).over(before), F.lit(0)))],
                [(carry2, F.min(F.col(carry) + F.col(tail2)).over(before))],
            ],
            F.col(carry) + F.col(loc) - F.least(F.lit(0), lowest),
        )
    raise ValueError(spec.kind)


def _add_layers(df: DataFrame, layers: list[list[list[tuple[str, Column]]]]) -> DataFrame:
    """Add first layers of all requests together, then second layers."""
    for depth in range(max((len(x) for x in layers), default=0)):
        columns = dict(pair for x in layers if depth < len(x) for pair in x[depth])
        df = df.withColumns(columns)
    return df


def running(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, ends_only: bool = False, **requests: Running
) -> DataFrame:
    """Add one column per request, computed along ``order`` within ``keys``.

    With ``ends_only`` only the last row of each chunk is given, among them the
    last one of each key; no other row is joined with what earlier chunks bring.

    Keys and chunk are wrapped in structs, which equal each other where they
    hold nulls. So the join is a plain one on what the rows are dealt and sorted
    by already, and the windowed rows are not shuffled once more for it.
    """
    names = {k: f"__key_{k}" for k in keys}
    held = [*names.values(), _CHUNK]
    inside = Window.partitionBy(*held).orderBy(*order)
    chunks = Window.partitionBy(*names.values()).orderBy(_CHUNK)
    parts = {name: _parts(name, spec, order, inside, chunks) for name, spec in requests.items()}
    wrapped = {n: F.struct(F.col(k).alias("v")) for k, n in names.items()} | {_CHUNK: F.struct(chunk.alias("v"))}

    local = _add_layers(df.withColumns(wrapped), [p.local for p in parts.values()])
    if ends_only or any(spec.kind in _ORDERED for spec in requests.values()):
        # These need the order inside the chunk: read them off its last row.
        ends = dict(pair for p in parts.values() for pair in p.end or p.tail)
        after = {"__after": F.lead(F.lit(1)).over(inside)}
        last = local.withColumns(ends | after).filter("__after IS NULL")
        tails = last.select(*held, *ends)
        if ends_only:
            local = last.drop("__after", *(n for n in ends if n not in local.columns))
    else:
        # Combined before the shuffle: one row per chunk and task moves.
        tails = local.groupBy(*held).agg(*(c.alias(n) for p in parts.values() for n, c in p.tail))
    carries = _add_layers(tails, [p.carry for p in parts.values()])
    wanted = [n for p in parts.values() for layer in p.carry for n, _ in layer]
    joined = local.join(carries.select(*held, *wanted), held, "inner")
    columns = [F.col(names[c])["v"].alias(c) if c in names else F.col(c) for c in df.columns]
    return joined.select(*columns, *(p.result.alias(name) for name, p in parts.items()))


def sliding(df: DataFrame, keys: list[str], along: str, width: int, **values: Column) -> DataFrame:
    """Sums over rows of the key with ``along`` (a whole number) in ``(x - width, x]``, at every row.

    Values are summed per place. A sum enters at its place and leaves ``width``
    later, so the sum within the width is a running sum of what comes and goes:
    linear in the places, whatever the width, and spread by chunks of
    ``CHUNK_ROWS`` places. Null keys count as a key of their own; a row without a
    place has no sum. Values should be whole numbers, which sum exactly.
    """
    names = {k: f"__k_{k}" for k in keys}
    held = [*names.values(), "__at"]
    per_place = df.filter(F.col(along).isNotNull()).groupBy(
        *(F.struct(F.col(k).alias("v")).alias(n) for k, n in names.items()), F.col(along).cast("long").alias("__at")
    ).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in values.items()))
    gone = per_place.select(*names.values(), (F.col("__at") + width).alias("__at"),
                            *((-F.col(v)).alias(v) for v in values), F.lit(False).alias("__here"))
    both = per_place.withColumn("__here", F.lit(True)).unionByName(gone)
    change = both.groupBy(*held).agg(*(F.sum(v).alias(v) for v in values), F.max("__here").alias("__here"))
    summed = running(change, list(names.values()), ["__at"], F.floor(F.col("__at") / CHUNK_ROWS),
                     **{f"__sum_{v}": total(F.col(v)) for v in values})
    found = summed.filter("__here").select(
        *(F.col(n)["v"].alias(k) for k, n in names.items()), F.col("__at").alias(along),
        *(F.col(f"__sum_{v}").alias(v) for v in values))
    return join_null_safe(df, found, [*keys, along])


def value_band(value: Column) -> Column:
    """Band number that never decreases with the value, 32 bands per doubling."""
    return F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * 32).cast("long")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
