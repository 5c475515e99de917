"""One row per event or per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], rank: list[str], pick) -> DataFrame:
    """Grouped pick: copies are reduced inside each task before the shuffle, so
    even an event sent a billion times reaches the reducer as one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*rank)).alias("row"))
    return best.select(*(c if c in keys else F.col("row")[c].alias(c) for c in df.columns))


def dedup_first(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The copy that arrived first."""
    return _pick(df, key, arrival, F.min_by)


def dedup_latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The copy with the highest version."""
    return _pick(df, keys, version, F.max_by)


RAW_KEY = ["match_id", "map_id", "round_no", "ts_event", "event_id"]
PREDICTION_KEY = ["match_id", "map_id", "ts_calc", "model_version"]
