"""Joins that keep rows whose key is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the keys come once, from the left."""
    names = {k: f"__right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[n]) for k, n in names.items()))
    return left.join(other, same, how).drop(*names.values())


def within(n: int, most: int) -> int:
    """A requested number of rows; more than a caller may ask for is refused, never cut."""
    if n > most:
        raise ValueError(f"{n} rows asked for, {most} are the most")
    return n
