"""Retries, dead letters and putting them back."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions.joins import within
from matchflow.functions import running as run
from matchflow.functions import scan
from matchflow.operators.dedup import dedup_first


def retry_exhausted(failures: DataFrame, max_retries: int = sc.MAX_RETRIES) -> DataFrame:
    """Events that failed ``max_retries`` times or more."""
    counted = failures.groupBy("event_id", "shard").agg(
        F.count("*").alias("retry_count"),
        F.min("failed_at").alias("first_failed_at"),
        F.max("failed_at").alias("last_failed_at"),
    )
    return counted.filter(F.col("retry_count") >= max_retries)


RETRY_LIFE_MS = 3_600_000  # fixed: a counter lives for an hour from its first failure


def _counted(times: np.ndarray, start: int, most: int, life: int) -> tuple[int, int]:
    """Failures counted and time of the first one in the counter that is open after the chunk, if one starts at ``start``."""
    n = len(times)
    while start < n:
        full = start + most
        if full <= n and times[full - 1] < times[start] + life:
            start = full
            continue
        after = int(np.searchsorted(times, times[start] + life))
        if after >= n:
            return n - start, int(times[start])
        start = after
    return 0, 0


def _entered(state: tuple[int, int], times, n: int, last: int, most: int, life: int) -> int | None:
    """Where the first counter of a chunk starts, given the one that is open before; None if that one stays open.

    ``times`` are the first ``most`` failures of the chunk: the open counter
    takes fewer than that before it is full or over.
    """
    count, first = state
    if not count:
        return 0
    need = most - count
    if n >= need and times[need - 1] < first + life:
        return need
    return None if last < first + life else int(np.searchsorted(times, first + life))


def retry_ledger(failures: DataFrame, max_retries: int = sc.MAX_RETRIES, life_ms: int = RETRY_LIFE_MS) -> DataFrame:
    """Every failure ``(event_id, shard, failed_at, failure_no)`` with the count ``tries`` it reached, and whether that was the last one.

    A counter starts with a failure and lives for ``life_ms``. At
    ``max_retries`` the event goes to the dead letters (``dead``) and the
    counter is gone; the next failure starts another. What a failure counts
    depends on all before it, yet a chunk of an event's failures matters to
    later ones only by where its first counter starts, and there are at most
    ``max_retries + 1`` places for that: chunks of one life each are summed up
    side by side.
    """
    keys, order = ["event_id", "shard"], ["failed_at", "failure_no"]
    rows = scan.chunked(failures.select(*keys, *order), F.floor(F.col("failed_at") / life_ms))

    def times_of(chunk: pa.Table) -> np.ndarray:
        return chunk.column("failed_at").to_numpy().astype(np.int64)

    def summary(chunk: pa.Table, carry: bytes | None) -> bytes:
        times = times_of(chunk)
        ends = [_counted(times, s, max_retries, life_ms) for s in range(min(max_retries, len(times)) + 1)]
        return pickle.dumps((times[:max_retries], len(times), int(times[-1]), ends))

    def step(state: bytes | None, told: bytes, carry: bytes | None) -> tuple[bytes, bytes]:
        before = pickle.loads(state) if state else (0, 0)
        times, n, last, ends = pickle.loads(told)
        start = _entered(before, times, n, last, max_retries, life_ms)
        return pickle.dumps(before), pickle.dumps((before[0] + n, before[1]) if start is None else ends[start])

    def work(chunk: pa.Table, carry: bytes | None) -> pa.Table:
        times, tries, firsts = times_of(chunk), [], []
        count, first = pickle.loads(carry) if carry else (0, 0)
        for at in times.tolist():
            if not count or count == max_retries or at >= first + life_ms:
                count, first = 0, at
            count += 1
            tries.append(count)
            firsts.append(first)
        return pa.table({
            "failed_at": chunk.column("failed_at"), "failure_no": chunk.column("failure_no"),
            "tries": pa.array(tries, pa.int64()), "first_failed_at": pa.array(firsts, pa.int64())})

    carries = scan.carried(scan.summed_up(rows, keys, order, summary), keys, step)
    out = scan.per_chunk(
        rows, keys, order, work, "failed_at bigint, failure_no bigint, tries bigint, first_failed_at bigint", carries)
    return out.drop(scan.CHUNK).withColumn("dead", F.col("tries") == max_retries)


def dlq_stats(dlq: DataFrame) -> DataFrame:
    """Entries per shard and, with a null shard, in total."""
    return dlq.rollup("shard").agg(F.count("*").alias("entries"))


def dlq_entries(dlq: DataFrame, limit: int = 100, shard: str | None = None, most: int = 1000) -> DataFrame:
    """Oldest entries of one shard, or of every shard."""
    rows = dlq.filter(F.col("shard") == shard) if shard else dlq
    oldest = Window.partitionBy("shard").orderBy("first_failed_at", "event_id")
    return rows.withColumn("place", F.row_number().over(oldest)).filter(F.col("place") <= within(limit, most))


def requeue(main: DataFrame, dlq: DataFrame, shard: str | None = None, entry: str | None = None) -> DataFrame:
    """Dead-letter events back among the stored ones, once each.

    ``dlq`` holds repaired events in the stored form plus their ``shard``.
    """
    back = dlq
    if shard:
        back = back.filter(F.col("shard") == shard)
    if entry:
        back = back.filter(F.col("event_id") == entry)
    rows = main.withColumn("requeued", F.lit(False)).unionByName(
        back.select(*main.columns).withColumn("requeued", F.lit(True))
    )
    return dedup_first(rows, ["event_id"], ["requeued", "ts_ingest"])


def trim_shard(df: DataFrame, shard: list[str], order: list[str], chunk: Column, keep: int) -> DataFrame:
    """The newest ``keep`` rows of every shard."""
    placed = run.running(df, shard, order, chunk, _n=run.row_number(), _all=run.whole(F.lit(1).cast("long")))
    return placed.filter(F.col("_all") - F.col("_n") < keep).drop("_n", "_all")
