"""Order of arrival against sequence numbers, per shard ``(match, map)``."""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions import ordering as od
from matchflow.functions import running as run
from matchflow.functions import scan as sn
from matchflow.session import cut

SHARD = ["match_id", "map_id"]


def sequence_gaps(arrivals: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Sequence numbers skipped since the event that arrived before."""
    seen = run.running(arrivals, SHARD, order, chunk, _last=run.previous(F.col("seq_no")))
    return seen.withColumn("gap", F.col("seq_no") - F.col("_last") - 1).drop("_last")


def late_events(
    arrivals: DataFrame, order: list[str], chunk: Column, lateness_ms: int = sc.MAX_LATENESS_MS
) -> DataFrame:
    """Events overtaken by a higher sequence number: old ones are dropped, the
    rest processed again. Both are kept as rows, so none disappears silently."""
    seen = run.running(arrivals, SHARD, order, chunk, _top=run.highest(F.col("seq_no"), prior=True))
    age = F.unix_millis("ts_ingest") - F.unix_millis("ts_event")
    late = seen.filter(F.col("seq_no") <= F.col("_top")).withColumn("age_ms", age)
    return late.withColumn("action", F.when(F.col("age_ms") <= lateness_ms, "reprocess").otherwise("drop")).drop("_top")


class _State(NamedTuple):
    """What a chunk of a shard starts from."""

    rows: int
    clock: int
    top: int | None
    seq: np.ndarray  # numbers near the highest one, since when they are here, and their events
    since: np.ndarray
    ids: list[str]
    last: int | None = None


#: What the first chunk of a shard starts from.
_FIRST = _State(0, -(1 << 62), None, *od.NOTHING, [])


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _near(top: int, clock: int, seq: np.ndarray, since: np.ndarray, ids: list[str], rules: od.Rules) -> tuple:
    """Of arrivals those that can wait still, by their time."""
    keep = np.flatnonzero((seq > top - rules.gap - 1) & (clock - since <= rules.lateness))
    keep = keep[np.argsort(since[keep], kind="stable")]
    return seq[keep], since[keep], [ids[i] for i in keep.tolist()]


def _arrivals(rules: od.Rules):
    """First pass: the highest number, the clock and what can wait at the end of a chunk."""

    def summary(rows: pa.Table, _: bytes | None) -> bytes:
        seq = _column(rows, "seq_no")
        clock = np.maximum.accumulate(_column(rows, "received_ms"))
        top = int(seq.max())
        near = np.flatnonzero(seq > top - rules.gap - 1)  # their age is known once the clock before the chunk is
        ids = rows.column("event_id").take(pa.array(near)).to_pylist()
        return pickle.dumps(_State(len(seq), int(clock[-1]), top, seq[near], clock[near], ids))

    def step(before: bytes | None, summary: bytes, _: bytes | None) -> tuple[bytes, bytes]:
        own = pickle.loads(summary)
        old = pickle.loads(before) if before else _State(0, own.clock, None, *od.NOTHING, [])
        clock = max(old.clock, own.clock)
        top = own.top if old.top is None else max(old.top, own.top)
        since = np.maximum(own.since, old.clock) if before else own.since
        held = _near(top, clock, np.concatenate([old.seq, own.seq]), np.concatenate([old.since, since]),
                     old.ids + own.ids, rules)
        known = old if before else _FIRST
        return pickle.dumps(known), pickle.dumps(_State(old.rows + own.rows, clock, top, *held))

    return summary, step


def _clock(rows: pa.Table, state: _State) -> np.ndarray:
    return np.maximum.accumulate(np.maximum(_column(rows, "received_ms"), state.clock))


def _maps(rules: od.Rules):
    """Second pass: where the last number can stand after a chunk, by where it stood before."""

    def summary(rows: pa.Table, carry: bytes | None) -> bytes:
        state, seq = pickle.loads(carry), _column(rows, "seq_no")
        top = int(seq[0]) - 1 if state.top is None else state.top
        maps, after = od.transitions(seq, _clock(rows, state), top, od.Held(state.seq, state.since), rules)
        return pickle.dumps((od.composed(maps)[-1], int(after[-1])))

    def step(before: bytes | None, summary: bytes, carry: bytes | None) -> tuple[bytes, bytes]:
        (whole, top), state = pickle.loads(summary), pickle.loads(carry)
        last = pickle.loads(before) if before else None
        place = 0 if last is None else state.top - last
        return pickle.dumps(state._replace(last=last)), pickle.dumps(top - int(whole[place]))

    return summary, step


_OUT = "event_id string, seq_no bigint, arrival_no bigint, code int, since_ms bigint"


def _outcomes(rules: od.Rules):
    """Third pass: what becomes of the arrivals of a chunk and of those that wait before it.

    Whatever still waits at the end of the chunk is the next one's to tell; the
    row given here is then only the last word if no chunk follows.
    """

    def work(rows: pa.Table, carry: bytes | None) -> pa.Table:
        state = pickle.loads(carry) if carry else _FIRST
        seq, clock = _column(rows, "seq_no"), _clock(rows, state)
        waits = np.flatnonzero((state.seq > state.last) if state.last is not None else np.zeros(0, bool))
        held = od.Held(state.seq[waits], state.since[waits])
        done = od.settle(seq, clock, _column(rows, "age_ms"), state.top, state.last, held, rules)
        ids = [state.ids[i] for i in waits.tolist()]
        return pa.table({
            "event_id": pa.concat_arrays([pa.array(ids, pa.string()), rows.column("event_id").combine_chunks().cast(pa.string())]),
            "seq_no": np.concatenate([held.seq, seq]),
            "arrival_no": pa.array([None] * len(waits) + list(range(state.rows + 1, state.rows + len(seq) + 1)), pa.int64()),
            "code": np.concatenate([done.held, done.own]).astype("i4"),
            "since_ms": np.concatenate([held.since, clock]),
        })

    return work


def sequence_actions(
    arrivals: DataFrame,
    order: list[str],
    chunk: Column,
    gap: int = sc.SEQ_GAP,
    lateness_ms: int = sc.MAX_LATENESS_MS,
    until_ms: Column | None = None,
    chunk_rows: int = run.CHUNK_ROWS,
) -> DataFrame:
    """What to do with each event on arrival, and what became of buffered ones.

    The next number is processed, and with it those that wait right behind it
    (``released``). One that is at most ``gap`` numbers ahead waits; one further
    ahead is processed at once, and what it passes is ``overtaken``. Numbers at
    or below the last are late: processed again while young, else dropped. What
    has waited for more than ``lateness_ms`` of the shard's clock (the highest
    intake time so far) has ``expired``. What waits to the end is ``waiting``, or
    expired if ``until_ms``, the clock at the end of the input, says so.

    No more than ``gap`` numbers can wait in a shard, so no further bound is
    needed. Copies of a waiting number share its fate.

    Shards are cut into chunks along the order of arrival (``scan``). Lost and
    repeated numbers need no special care: an arrival is a map on ``gap + 2``
    possible places of the last number, and chunks are composed of such maps.
    A shard of at most ``chunk_rows`` rows is one chunk, worked through at once.
    Input holds each event once (see ``dedup``).
    """
    rules = od.Rules(gap, lateness_ms)
    slim = cut(sn.chunked(arrivals.select(
        *SHARD, "event_id", "seq_no", *(c for c in order if c not in (*SHARD, "event_id", "seq_no")),
        F.unix_millis("ts_ingest").alias("received_ms"),
        (F.unix_millis("ts_ingest") - F.unix_millis("ts_event")).alias("age_ms"), chunk.alias(sn.CHUNK),
    ), F.col(sn.CHUNK)))
    # One row per busy shard, so at most one in ``chunk_rows`` rows of the input.
    busy = F.broadcast(slim.groupBy(*SHARD).agg(F.count("*").alias("n")).filter(F.col("n") > chunk_rows).select(*SHARD))
    cut_up = slim.join(busy, SHARD, "left_semi")
    at_once = slim.join(busy, SHARD, "left_anti").withColumn(sn.CHUNK, F.lit(0).cast("long"))
    summary, step = _arrivals(rules)
    starts = sn.carried(sn.summed_up(cut_up, SHARD, order, summary), SHARD, step)
    summary, step = _maps(rules)
    carries = sn.carried(sn.summed_up(cut_up, SHARD, order, summary, starts), SHARD, step)
    told = sn.per_chunk(at_once.unionByName(cut_up), SHARD, order, _outcomes(rules), _OUT, carries)
    waiting = F.col("code") == od.WAITING
    # An event that waits across chunks is told of by each: the one that knows its end counts.
    once = told.groupBy(*SHARD, "event_id", "seq_no").agg(
        F.max("arrival_no").alias("arrival_no"), F.min("since_ms").alias("since_ms"), F.min("code").alias("code"))
    if until_ms is not None:
        gone = waiting & (until_ms - F.col("since_ms") > lateness_ms)
        once = once.withColumn("code", F.when(gone, od.EXPIRED).otherwise(F.col("code")))
    names = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(o).alias("outcome")) for a, o in od.NAMES))
    return once.withColumn("named", F.get(names, F.col("code"))).select(
        *SHARD, "event_id", "seq_no", "arrival_no", "named.action", "named.outcome", "since_ms")


def sequence_stats(actions: DataFrame) -> DataFrame:
    """Counts per shard: all, out of order, gaps, released late, dropped."""
    action, outcome = F.col("action"), F.col("outcome")
    return actions.groupBy(*SHARD).agg(
        F.count("*").alias("total_events"),
        F.count_if(action.isin("reprocess", "drop")).alias("out_of_order_events"),
        F.count_if((action == "buffer") | (outcome == "gap_skipped")).alias("gaps_detected"),
        F.count_if(outcome == "released").alias("late_events_processed"),
        F.count_if((action == "drop") | outcome.isin("expired", "overtaken")).alias("late_events_dropped"),
    )
