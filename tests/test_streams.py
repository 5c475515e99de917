"""Streams across micro-batches and restarts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from matchflow import schema as sc
from matchflow.functions import running as run
from matchflow.operators import scoring, sequence
from matchflow.operators import state as st
from matchflow.plans import tables
from matchflow.sources import fixtures as fx
from matchflow.streaming import jobs
from matchflow.streaming import pipeline as pl
from matchflow.streaming.processors import SequenceProcessor
from matchflow.streaming.states import StateTables, state_sink

SF = f"{DATA}/sf0.001"
NOW = {"availableNow": True}


def flat(rows):
    return {r.event_id: (r.state_version, r.round_no, r.phase, r.team_a, r.team_b) for r in rows.collect()}


def test_late_events_correct_states_and_predictions(spark, tmp_path):
    """Every third event comes in a second run, after all others: the end is that of the batch form."""
    raw = tables.events(spark, SF).filter("match_id < '00000000-0000-4000-8000-000000000006'").select(*sc.RAW.names).cache()
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for late in (False, True):
        raw.filter((F.crc32("event_id") % 3 == 0) == late).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(sc.RAW).parquet(source)
        pl.drain(pl.state_stage(stream, out, NOW))
    kept = StateTables(spark, out)
    states = st.match_state(raw).cache()
    assert flat(kept.states.read()) == flat(states)
    want = {r.trigger_event_id: (r.state_version, r.p_team_a_win, r.odds_a) for r in scoring.predictions(states).collect()}
    got = {r.trigger_event_id: (r.state_version, pytest.approx(r.p_team_a_win), pytest.approx(r.odds_a))
           for r in kept.predictions.read().collect()}
    assert want == got
    assert kept.states.deltas().count() > raw.count()  # corrections were written


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    """Chunks of few numbers, a batch that fails after its writes and comes again, a late event behind all."""
    raw = tables.events(spark, SF).filter("match_id < '00000000-0000-4000-8000-000000000003'").select(*sc.RAW.names).cache()
    sink = state_sink(f"{tmp_path}", chunk_rows=8)
    name = "sql.streaming.queryId"
    try:
        spark.sparkContext.setLocalProperty(name, "q")
        for batch, part in ((0, "seq_no <> 5"), (1, "seq_no = 5"), (1, "seq_no = 5")):
            sink(raw.filter(part), batch)
    finally:
        spark.sparkContext.setLocalProperty(name, None)
    kept = StateTables(spark, f"{tmp_path}")
    want = flat(st.match_state(raw))
    assert flat(kept.states.read()) == want
    kept.states.compact()
    assert flat(kept.states.read()) == want


def test_repeated_batch_replaces_itself(spark, tmp_path):
    sink = pl.batch_sink((f"{tmp_path}/t", lambda b: b))
    rows = spark.range(5)
    sink(rows, 0)
    sink(rows, 0)
    sink(rows, 1)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 10


def test_streamed_actions_cover_every_event(spark):
    """One row per event that has settled; the rest waits, as the batch form says."""
    rows = spark.read.parquet(f"{jobs.sequence(spark, SF)}/actions")
    live = fx.live(tables.events(spark, SF)).withColumn("ms", F.unix_millis("ts_ingest"))
    end = live.agg(F.max("ms") - 10_000).first()[0]
    batch = sequence.sequence_actions(live, ["ms", "event_id"], F.floor(F.col("ms") / 9_000), until_ms=F.lit(end))
    want = {r.event_id: (r.action, r.outcome, r.since_ms) for r in batch.collect()}
    got = {r.event_id: (r.action, r.outcome, r.since_ms) for r in rows.collect()}
    assert rows.count() == len(got)
    waiting = {e for e, (_, outcome, _) in want.items() if outcome == "waiting"}
    assert got == {e: w for e, w in want.items() if e not in waiting}
    assert len(want) == live.count() and sum(w[1] == "expired" for w in want.values()) > 20


def test_timers_end_the_wait_of_a_silent_shard(spark, tmp_path):
    """Batch by batch: an old row is not dropped, a shard without rows still lets go, idle shards are forgotten."""
    batches = [
        [("a", 1, 0), ("a", 3, 1_000), ("b", 5, 1_000), ("b", 7, 1_500)],
        [("b", 8, 2_500), ("b", 6, 100)],  # 6 was taken in long before the watermark: still in order
        [("c", 1, 60_000), ("a", 2, 60_100)],
        [("c", 2, 9_000_000), ("a", 9, 9_000_000)],
        [("a", 1, 18_000_000)],
        [("d", 1, 18_000_200)],
        [("c", 1, 18_000_300)],
    ]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(f"{m}{s}-{t}", m, "x", s, t) for m, s, t in rows],
                                      "event_id string, match_id string, map_id string, seq_no long, ms long")
        frame.select("event_id", "match_id", "map_id", "seq_no", F.timestamp_millis("ms").alias("ts_event"),
                     F.timestamp_millis("ms").alias("ts_ingest")).coalesce(1).write.parquet(f"{tmp_path}/in/slice={i}")
    pl.use_rocksdb(spark)
    schema = "event_id string, match_id string, map_id string, seq_no long, ts_event timestamp, ts_ingest timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/slice=*")
    sink = pl.batch_sink((f"{tmp_path}/out", lambda b: b))
    pl.drain(pl.start(pl.sequence_stage(stream, "0 seconds"), f"{tmp_path}/c", sink, trigger=NOW, timers=True))
    got = {r.event_id: (r.outcome, r.batch) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        "a1-0": ("in_order", 0), "b5-1000": ("in_order", 0), "b6-100": ("in_order", 1), "b7-1500": ("released", 1),
        "b8-2500": ("in_order", 1),  # a batch is worked off in order of intake
        "a3-1000": ("expired", 2),  # nothing of shard a came in batch 1, and the watermark of batch 2 is 2500
        "c1-60000": ("in_order", 2), "a2-60100": ("in_order", 2), "c2-9000000": ("in_order", 3),
        "a9-9000000": ("expired", 4), "a1-18000000": ("late", 4), "d1-18000200": ("in_order", 5),
        "c1-18000300": ("in_order", 6),  # forgotten after two idle hours, so the first again
    }


def test_batch_actions_of_ordered_events_are_all_in_order(spark):
    rows = sequence.sequence_actions(
        tables.events(spark, SF), ["seq_no", "event_id"], F.floor(F.col("seq_no") / run.CHUNK_ROWS)
    )
    assert {(r.action, r.outcome) for r in rows.select("action", "outcome").distinct().collect()} == {
        ("process", "in_order")
    }


def test_a_shard_costs_one_read_and_one_write_per_batch():
    """Timers only where an event begins to wait or an hour begins; what waits is kept with the place."""
    calls = []

    class Place:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return Place()

        def registerTimer(self, at):
            calls.append(at)

    processor = SequenceProcessor()
    processor.init(Handle())
    out = []
    for seq, ms in ([1, 2], 0), ([3, 5], 1_000), ([4], 2_000), ([6, 7], 3_000):
        frame = pd.DataFrame({"match_id": "m", "map_id": "x", "event_id": [f"e{n}" for n in seq], "seq_no": seq,
                              "received_ms": ms, "age_ms": 10})
        out += [tuple(r) for f in processor.handleInputRows(("m", "x"), iter([frame]), None)
                for r in f[["event_id", "outcome", "since_ms"]].to_numpy()]
    assert calls == ["get", 3 * 3_600_000, "update", "get", 3_001, "update", *["get", "update"] * 2]
    assert out == [("e1", "in_order", 0), ("e2", "in_order", 0), ("e3", "in_order", 1_000), ("e5", "released", 1_000),
                   ("e4", "in_order", 2_000), ("e6", "in_order", 3_000), ("e7", "in_order", 3_000)]


def test_files_of_a_slice_grow_with_the_table(spark, monkeypatch):
    """More files, and so more tasks, in as many micro-batches as before."""
    monkeypatch.setattr(jobs, "FILE_EVENTS", 100)
    monkeypatch.setattr(jobs, "_ran", {f"other {i}": "" for i in range(1000)})
    wanted = -(-tables.events(spark, SF).count() // 100)
    folder = jobs.live_folder(spark, SF)
    slices = spark.read.parquet(folder).select("slice", F.input_file_name()).distinct().groupBy("slice").count().collect()
    assert wanted > jobs.FILES and [r["count"] for r in slices] == [wanted] * 4
