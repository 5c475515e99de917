"""Was every received event stored, and how far did each provider get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_events(received: DataFrame, stored: DataFrame) -> DataFrame:
    """Received events that were not stored. Copies are reduced first."""
    distinct = received.groupBy("match_id", "event_id").agg(F.min("ts_ingest").alias("first_received"))
    return distinct.join(stored.select("event_id"), "event_id", "left_anti")


def match_integrity(received: DataFrame, stored: DataFrame) -> DataFrame:
    """Per match: distinct events received and stored, ratio and check sums."""
    both = received.select("match_id", "event_id", F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(
        stored.select("match_id", "event_id", F.lit(0).alias("r"), F.lit(1).alias("s"))
    )
    events = both.groupBy("match_id", "event_id").agg(F.max("r").alias("r"), F.max("s").alias("s"))
    crc = F.crc32("event_id")
    return events.groupBy("match_id").agg(
        F.sum("r").alias("received"), F.sum(F.col("r") * F.col("s")).alias("stored"),
        F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("s")), F.sum("r")).cast("double"), F.lit(1.0))
        .alias("stored_ratio"),
        (F.sum(crc * F.col("r")) == F.sum(crc * F.col("s"))).alias("checksum_equal"),
    )


def replay_cursors(events: DataFrame) -> DataFrame:
    """Last sequence number and time per match and provider."""
    return events.groupBy("match_id", "source").agg(
        F.max("seq_no").alias("last_seq_no"), F.max_by("ts_event", "seq_no").alias("last_event_ts")
    )
