"""Stored tables that queries read: events and predictions.

Both are derived from the given tables once per application, as intake and
scoring jobs would do, and written to the shared folder. Queries then scan
Parquet with pruned columns and pushed filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchflow.operators import scoring, state
from matchflow.session import prepare, shared_path
from matchflow.sources import fixtures, store

_built: set[str] = set()


def _stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> DataFrame:
    prepare(spark)
    path = shared_path(spark, f"{name}-{zlib.crc32(sf_dir.encode()):08x}")
    if path not in _built:
        write(path)
        _built.add(path)
    return spark.read.parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(
        spark, sf_dir, "events",
        lambda path: store.append_raw(fixtures.events(spark, sf_dir, deal=store.by_range), path, "overwrite", dealt=True),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.match_state(events(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        rows = store.time_columns(scoring.predictions(states(spark, sf_dir)), "ts_calc", "ts_calc")
        (
            rows.drop("event_hour", "ingest_day")
            .repartitionByRange("month", "match_id", "state_version")
            .sortWithinPartitions("month", "match_id", "map_id", "ts_calc", "model_version")
            .write.mode("overwrite").partitionBy("month").parquet(path)
        )

    return _stored(spark, sf_dir, "predictions", write)
