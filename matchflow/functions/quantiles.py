"""Quantiles from stored partials that merge to any width.

``partials`` reads rows once and keeps how often each value occurs; ``bands``
sums these up to a sketch of at most a few thousand bands per group. Sketches
add, so one per minute gives those of hours or days. ``approx`` answers from
the sketch alone. ``exact`` uses it to find the bands that hold the wanted
ranks and looks only at the values of these.

A band is 1/32 of a doubling of ``|value| + 1``, so an answer of the sketch
is off by at most ``ERROR * (|value| + 1)``. Null values count as rows, NaN
counts as larger than all numbers, groups may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.functions.joins import join_null_safe
from matchflow.functions.running import value_band

ERROR = 2 ** (1 / 32) - 1
BAND, ROWS = "band", "n"
_LAST = 2**62  # band of NaN
_FIRST = Window.unboundedPreceding


def partials(df: DataFrame, groups: list[str], value: str, **sums: Column) -> DataFrame:
    """Rows ``n`` and sums per group and value; combined inside tasks before the shuffle."""
    counted = df.groupBy(*groups, value).agg(
        F.count("*").alias(ROWS), *(F.sum(c).alias(name) for name, c in sums.items()))
    return counted.withColumn(BAND, F.when(F.isnan(value), F.lit(_LAST)).otherwise(value_band(F.col(value))))


def bands(parts: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The sketch: rows, lowest and highest value per group and band."""
    return parts.filter(F.col(value).isNotNull()).groupBy(*groups, BAND).agg(
        F.sum(ROWS).alias(ROWS), F.min(value).alias("low"), F.max(value).alias("high"))


def merge(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of finer groups as one per coarser group."""
    return sketch.groupBy(*groups, BAND).agg(
        F.sum(ROWS).alias(ROWS), F.min("low").alias("low"), F.max("high").alias("high"))


def _placed(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Rows before each band and of the whole group. A group has few bands, whatever its rows."""
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy(BAND).rowsBetween(_FIRST, 0)
    return sketch.withColumns({
        "before": F.sum(ROWS).over(upto) - F.col(ROWS), "size": F.sum(ROWS).over(whole)})


def _position(q: float) -> Column:
    return (F.col("size") - 1) * F.lit(float(q))


def _ranks(q: float) -> tuple[Column, Column]:
    return F.floor(_position(q)), F.ceil(_position(q))


def _holds(rank: Column) -> Column:
    return (rank >= F.col("before")) & (rank < F.col("before") + F.col(ROWS))


def _interpolated(rows: DataFrame, groups: list[str], wanted: dict[str, float], at) -> DataFrame:
    """From one row per place to one per group; ``at(rank)`` is the value where the row holds the rank."""
    picks, outs = [], []
    for name, q in wanted.items():
        low, high = _ranks(q)
        picks += [F.max(F.when(_holds(low), at(low))).alias(f"__lo_{name}"),
                  F.max(F.when(_holds(high), at(high))).alias(f"__hi_{name}"),
                  F.max(_position(q) - low).alias(f"__part_{name}")]
        a, b, part = (F.col(f"__{p}_{name}") for p in ("lo", "hi", "part"))
        outs.append((a + (b - a) * part).alias(name))
    return rows.groupBy(*groups).agg(*picks).select(*groups, *outs)


def approx(sketch: DataFrame, groups: list[str], wanted: dict[str, float]) -> DataFrame:
    """Interpolated quantiles from the sketch; ranks lie evenly between the ends of their band."""

    def inside(rank: Column) -> Column:
        step = (F.col("high") - F.col("low")) / F.greatest(F.col(ROWS) - 1, F.lit(1))
        return F.col("low") + step * (rank - F.col("before"))

    return _interpolated(_placed(sketch, groups), groups, wanted, inside)


def exact(parts: DataFrame, groups: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Interpolated quantiles. Only values of bands that hold a wanted rank are put in order."""
    some = F.lit(False)
    for q in wanted.values():
        for rank in _ranks(q):
            some = some | _holds(rank)
    needed = _placed(bands(parts, groups, value), groups).filter(some).select(*groups, BAND, "before", "size")
    counts = parts.filter(F.col(value).isNotNull()).groupBy(*groups, BAND, value).agg(F.sum(ROWS).alias(ROWS))
    inside = Window.partitionBy(*groups, BAND).orderBy(value).rowsBetween(_FIRST, 0)
    ordered = join_null_safe(counts, needed, [*groups, BAND], "inner").withColumn(
        "before", F.col("before") + F.sum(ROWS).over(inside) - F.col(ROWS))
    return _interpolated(ordered, groups, wanted, lambda rank: F.col(value))
