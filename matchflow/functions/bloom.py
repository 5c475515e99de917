"""Bloom filters as tables: which ids may have been seen before.

An id sets eight bits of one block of 256. A filter is a table of blocks, one
row each, so it is built by a grouped ``bit_or``, grows by appending rows, and
is asked by one join. It has no false negatives; false positives cost a look
into the full table, nothing else. With sixteen ids a block about one other id
in two hundred passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 24
_WORDS = ["w0", "w1", "w2", "w3"]


def _word(hashed: str, number: int) -> Column:
    """One of the four words of a block with the bits that an id sets there."""
    bits = [
        F.expr(f"CASE WHEN shiftright({hashed}, {8 * i + 6}) & 3 = {number} "
               f"THEN shiftleft(1L, CAST(shiftright({hashed}, {8 * i}) & 63 AS INT)) ELSE 0L END")
        for i in range(8)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def signed(rows: DataFrame, ids: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Rows with the block and the bits of their id."""
    hashed = rows.withColumns({
        "block": F.pmod(F.xxhash64(*ids), F.lit(blocks)), "_bits": F.xxhash64(*ids, F.lit("bits")),
    })
    return hashed.withColumns({w: _word("_bits", i) for i, w in enumerate(_WORDS)}).drop("_bits")


def filter_of(rows: DataFrame, within: list[str], ids: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Filter of the ids, one for each value of ``within``."""
    return merged(signed(rows, ids, blocks).select(*within, "block", *_WORDS), within)


def merged(filters: DataFrame, within: list[str]) -> DataFrame:
    """Filters of parts as one."""
    return filters.groupBy(*within, "block").agg(*(F.bit_or(w).alias(w) for w in _WORDS))


def may_contain(rows: DataFrame, filters: DataFrame, within: list[str], ids: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Rows whose id may be in the filter; all others are certainly not."""
    told = filters.select(*within, "block", *(F.col(w).alias(f"_{w}") for w in _WORDS))
    found = signed(rows, ids, blocks).join(told, [*within, "block"])
    for w in _WORDS:
        found = found.filter(F.col(w).bitwiseAND(F.col(f"_{w}")) == F.col(w))
    return found.select(*rows.columns)
