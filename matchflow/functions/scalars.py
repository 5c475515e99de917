"""Column functions: probabilities, odds, sharding, time and JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow import schema as sc

# Fixed values of the probability and odds rules.
MIN_PROB, MAX_PROB, NO_PROB = 0.01, 0.99, 0.5
ODDS_MARGIN = 0.06


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_probability(p: Column) -> Column:
    """NaN, infinite or missing gives 0.5, all else is held in [0.01, 0.99]."""
    broken = p.isNull() | F.isnan(p) | (F.abs(p) == F.lit(float("inf")))
    return F.when(broken, F.lit(NO_PROB)).otherwise(clamp(p, MIN_PROB, MAX_PROB))


def decimal_odds(p: Column, margin: float = ODDS_MARGIN) -> Column:
    return F.round(1 / (clamp(p, MIN_PROB, MAX_PROB) * (1 + margin)), 3)


def american_odds(decimal: Column) -> Column:
    """Halves round towards plus infinity. Even money (1.0) has no American price."""
    profit = decimal - 1
    price = F.when(decimal >= 2, profit * 100).when(profit != 0, F.lit(-100) / profit)
    return F.floor(price + 0.5).cast("long")


def shard_number(match_id: Column, map_id: Column, shards: int = sc.SHARDS) -> Column:
    return (F.crc32(F.concat_ws(":", match_id, map_id)) % shards).cast("long")


def cursor(offset: Column) -> Column:
    return F.base64(offset.cast("string").cast("binary"))


def cursor_offset(text: Column) -> Column:
    return F.unbase64(text).cast("string").try_cast("long")


def latency_status(p95_ms: Column) -> Column:
    return (
        F.when(p95_ms <= sc.LATENCY_WARNING_MS, "healthy")
        .when(p95_ms <= sc.LATENCY_TARGET_MS, "warning")
        .otherwise("critical")
    )


def error_status(percent: Column) -> Column:
    return (
        F.when(percent <= sc.ERROR_WARNING_PCT, "healthy")
        .when(percent <= sc.ERROR_TARGET_PCT, "warning")
        .otherwise("critical")
    )


def score_text(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a.cast("string"), b.cast("string"))


def lag_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, 0 when one is missing."""
    return F.coalesce(F.unix_millis(end) - F.unix_millis(start), F.lit(0).cast("long"))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed (not the rounded difference)."""
    return F.unix_timestamp(F.date_trunc("second", end)) - F.unix_timestamp(F.date_trunc("second", start))


def parse_payload(df: DataFrame, *names: str) -> DataFrame:
    """Parse the payload once into column ``p``, with the named fields only."""
    return df.withColumn("p", F.from_json("payload", sc.payload_type(*names)))


def text(name: str) -> Column:
    """Payload text with '' for a missing key."""
    return F.coalesce(F.col(f"p.{name}"), F.lit(""))


def flag(name: str) -> Column:
    return F.coalesce(F.col(f"p.{name}"), F.lit(False))


def number(name: str) -> Column:
    return F.coalesce(F.col(f"p.{name}"), F.lit(0).cast("long"))


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")
