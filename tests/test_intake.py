"""Validation, sequence order, usage rules and scalar functions."""

import json
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from matchflow.functions import ordering as od
from matchflow.functions import scalars as fn
from matchflow.functions import scan as sn
from matchflow.operators import dead_letter, intake, sequence, slo, usage
from matchflow.schema import WIRE
from matchflow.sources import store

ID = "00000000-0000-4000-8000-00000000000{}"
GOOD = {
    "event_id": ID.format(1), "match_id": ID.format(2), "map_id": ID.format(3), "round_no": "1",
    "ts_event": "2024-01-01T00:00:00.000Z", "ts_ingest": "2024-01-01T00:00:00.100Z", "type": "player_hurt",
    "source": "p", "seq_no": "1", "payload": "{}", "trace_id": "t", "event_schema_version": "1.0.0",
}
CASES = [
    ({}, []),
    ({"match_id": "match-1"}, ["match_id"]),
    ({"round_no": None, "seq_no": None}, ["round_no", "seq_no"]),
    ({"source": None}, ["source"]),
    ({"payload": "[1]"}, ["payload"]),
    ({"payload": '{"x":"' + "y" * 70_000 + '"}'}, ["size"]),
    ({"ts_event": "2024-13-01T00:00:00Z"}, ["ts_event", "clock_skew"]),
    ({"ts_ingest": "2024-01-01T00:01:00.000Z"}, ["clock_skew"]),
    ({"ts_event": "2024-01-01T00:00:10.000Z"}, ["from_future"]),
    ({"round_no": "51"}, ["round_no"]),
    ({"event_schema_version": "2.0.0"}, ["version"]),
    ({"type": "bomb_planted", "payload": '{"player_id":"x","player_team":"C","site":"A"}'}, ["payload.player_team"]),
]


def wire(spark, changes):
    rows = [tuple({**GOOD, **c}[n] for n in WIRE.names) for c in changes]
    return spark.createDataFrame(rows, WIRE)


@pytest.mark.parametrize("change,errors", CASES)
def test_validation(spark, change, errors):
    row = intake.validate(wire(spark, [change]), strict=True, typed=True, skew_ms=30_000).first()
    assert row.errors == errors


def test_split_and_batches(spark):
    rows = wire(spark, [{}, {}, {"event_id": ID.format(4)}, {"map_id": "x", "event_id": ID.format(5)}])
    outcomes = {r.outcome: r.events for r in intake.batch_outcomes(intake.validate(rows)).collect()}
    assert outcomes == {"processed": 2, "duplicate": 1, "error": 1}
    good, bad = intake.split(intake.validate(rows))
    assert (good.count(), bad.count()) == (3, 1)
    assert intake.quarantine(bad).first().error == "map_id"
    batches = rows.groupBy().agg(F.collect_list(F.struct(*WIRE.names)).alias("events"))
    assert intake.explode_batches(batches, limit=3).filter("oversized").count() == 4


def arrivals(spark, rows):
    frame = spark.createDataFrame(rows, "match_id string, map_id string, event_id string, seq_no long, place long, ms long")
    return frame.select(
        "match_id", "map_id", "event_id", "seq_no", "place", F.timestamp_millis("ms").alias("ts_event"),
        F.timestamp_millis(F.col("ms") + F.when(F.col("seq_no") % 9 == 0, 5000).otherwise(50)).alias("ts_ingest"),
    )


def test_event_before_its_turn_waits(spark):
    rows = [("m", "x", f"e{s}", s, i, 1000 + i) for i, s in enumerate([10, 12, 11])]
    got = sequence.sequence_actions(arrivals(spark, rows), ["place"], F.col("place") * 0)
    assert {r.seq_no: (r.action, r.outcome) for r in got.collect()} == {
        10: ("process", "in_order"), 12: ("buffer", "released"), 11: ("process", "in_order"),
    }


def fold(events, gap=10, lateness=2000):
    """One shard, event after event: (id, number, clock, age) to action and outcome."""
    last, waiting, out = None, [], {}
    for event, seq, clock, age in events:
        out |= {w[2]: ("buffer", "expired") for w in waiting if clock - w[1] > lateness}
        waiting = [w for w in waiting if clock - w[1] <= lateness]
        skipped = 0 if last is None else seq - last - 1
        if skipped < 0:
            out[event] = ("reprocess", "late") if age <= lateness else ("drop", "too_late")
        elif 0 < skipped <= gap:
            waiting.append((seq, clock, event))
        else:
            out[event] = ("process", "gap_skipped" if skipped else "in_order")
            last = seq
            out |= {w[2]: ("buffer", "overtaken") for w in waiting if w[0] <= last}
            while any(w[0] == last + 1 for w in waiting):
                last += 1
                out |= {w[2]: ("buffer", "released") for w in waiting if w[0] == last}
            waiting = [w for w in waiting if w[0] > last]
    return out | {w[2]: ("buffer", "waiting") for w in waiting}


def folded(frame):
    out, shards = {}, {}
    for r in sorted(frame.collect(), key=lambda r: r.place):
        shards.setdefault(r.map_id, []).append(r)
    for rows in shards.values():
        clock, events = 0, []
        for r in rows:
            event, got = round(r.ts_event.timestamp() * 1000), round(r.ts_ingest.timestamp() * 1000)
            clock = max(clock, got)
            events.append((r.event_id, r.seq_no, clock, got - event))
        out |= fold(events)
    return out


@pytest.mark.parametrize("size", [1, 7, 25, 1000])
def test_sequence_actions_equal_the_fold(spark, size):
    """Calm, jittered, lossy and repeating shards, whatever the chunks."""
    pick = random.Random(3)
    rows = []
    for shard, jitter, loss in (("calm", 0, 0.0), ("jitter", 4, 0.0), ("lossy", 2, 0.1), ("wild", 30, 0.05)):
        kept = [s for s in range(1, 160) if pick.random() >= loss]
        order = sorted(kept, key=lambda s: s + pick.random() * jitter)
        if shard == "lossy":
            order.insert(40, order[20])
        rows += [("m", shard, f"{shard}{i}", s, i, 1000 * i // 3) for i, s in enumerate(order)]
    # All at one time: what waits is never old, and copies of a waiting number share its fate.
    rows += [("m", "copies", f"c{i}", s, i, 7) for i, s in enumerate([5, 7, 7, 9, 9, 8, 6, 6, 12, 30, 31, 40, 41, 42])]
    frame = arrivals(spark, rows)
    got = sequence.sequence_actions(frame, ["place"], F.floor(F.col("place") / size)).collect()
    assert {r.event_id: (r.action, r.outcome) for r in got} == folded(frame)
    assert len(got) == len(rows)
    for shard in ("calm", "wild"):
        assert sorted(r.arrival_no for r in got if r.map_id == shard) == list(range(1, 1 + sum(x[1] == shard for x in rows)))


def test_lost_and_repeated_numbers_do_not_join_chunks(spark):
    """Every 97th event is lost and one number comes twice: the state handed on stays small."""
    rows = [("m", "hot", f"e{i}", i if i != 1500 else 1400, i, 400 * i) for i in range(1, 3000) if i % 97]
    frame = arrivals(spark, rows)
    got = sequence.sequence_actions(frame, ["place"], F.floor(F.col("place") / 100)).collect()
    assert {r.event_id: (r.action, r.outcome) for r in got} == folded(frame)
    slim = sn.chunked(frame.withColumns({"received_ms": F.unix_millis("ts_ingest")}), F.floor(F.col("place") / 100))
    summary, step = sequence._arrivals(od.Rules(10, 2000))
    carries = sn.carried(sn.summed_up(slim, sequence.SHARD, ["place"], summary), sequence.SHARD, step).collect()
    assert len(carries) == 30
    assert max(len(pickle.loads(r["_carry"]).ids) for r in carries) <= 11


def test_waiting_events_expire_by_the_end_of_the_input(spark):
    rows = [("m", "x", "a", 1, 0, 0), ("m", "x", "b", 3, 1, 1000), ("m", "x", "c", 4, 2, 2500)]
    got = sequence.sequence_actions(arrivals(spark, rows), ["place"], F.col("place"), until_ms=F.lit(4000).cast("long"))
    assert {r.event_id: r.outcome for r in got.collect()} == {"a": "in_order", "b": "expired", "c": "waiting"}


def test_composed_maps_equal_one_after_the_other():
    rng = np.random.default_rng(5)
    maps = rng.integers(0, 12, (37, 12))
    now = np.arange(12)
    for i, whole in enumerate(od.composed(maps)):
        now = maps[i][now]
        assert (whole == now).all()


def test_trim_keeps_the_newest(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("shard"), "id")
    kept = dead_letter.trim_shard(rows, ["shard"], ["id"], F.floor(F.col("id") / 30), 120)
    assert {r.shard: (r.n, r.low) for r in kept.groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()} == {
        "hot": (120, 280), "cold": (100, 400),
    }


def test_shard_number_is_crc32(spark):
    row = spark.range(1).select(fn.shard_number(F.lit("m1"), F.lit("map2")).alias("s")).first()
    assert row.s == zlib.crc32(b"m1:map2") % 16


def test_odds(spark):
    row = spark.range(1).select(
        fn.decimal_odds(F.lit(0.5)).alias("even"), fn.decimal_odds(F.lit(0.0), 0.0).alias("low"),
        fn.american_odds(F.lit(2.5)).alias("dog"), fn.american_odds(F.lit(1.5)).alias("favourite"),
        fn.american_odds(F.lit(1.0)).alias("none"), fn.safe_probability(F.lit(float("inf"))).alias("broken"),
        fn.cursor_offset(fn.cursor(F.lit(41))).alias("offset"),
        fn.seconds_between(F.timestamp_millis(F.lit(1999)), F.timestamp_millis(F.lit(2001))).alias("edge"),
    ).first()
    assert tuple(row) == (1.887, 100.0, 150, -200, None, 0.5, 41, 1)


def test_access_rules(spark):
    rows = spark.createDataFrame(
        [(["*"], "read:x", [], "1.2.3.4"), (["read:*"], "read:x", ["1.2.3.0/24"], "1.2.3.4"),
         (["write:*"], "read:x", ["1.2.3.5", "1.2.0.0/16"], "1.2.3.4"), (["read:x"], "read:x", ["1.2.3.4"], "1.2.3.4")],
        "permissions array<string>, needed string, ips array<string>, ip string",
    )
    got = rows.select(usage.has_scope("permissions", F.col("needed")), usage.ip_allowed("ips", F.col("ip"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (False, False), (True, True)]


def test_histogram_quantile_in_open_bucket(spark):
    rows = spark.createDataFrame([("x", float(v)) for v in (1, 2, 50, 60)], "l string, v double")
    hist = slo.histogram(rows, "v", ["l"], [5, 10])
    assert slo.histogram_quantile(hist, ["l"], 0.9).first()["quantile"] == 10.0
    assert slo.histogram_quantile(hist, ["l"], 0.25).first()["quantile"] == 2.5


def test_raw_table_round_trip(spark, tmp_path):
    good, _ = intake.split(intake.validate(wire(spark, [{}, {"event_id": ID.format(4), "seq_no": "2"}])))
    store.append_raw(intake.typed_events(good), f"{tmp_path}/raw")
    raw = store.read_raw(spark, f"{tmp_path}/raw")
    assert [r.month for r in raw.select("month").distinct().collect()] == [202401]
    store.export_matches(raw, f"{tmp_path}/out")
    back = store.import_matches(spark, f"{tmp_path}/out")
    columns = ["event_id", "seq_no", "ts_event", "payload"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, raw.select(columns).collect()))


LINE = {
    "event_id": "00000000-0000-4000-8000-000000000001", "match_id": "00000000-0000-4000-8000-000000000002",
    "map_id": "00000000-0000-4000-8000-000000000003", "round_no": 3, "ts_event": "2024-01-01T00:00:00.000Z",
    "ts_ingest": "2024-01-01T00:00:01.000Z", "type": "economy_update", "source": "s", "seq_no": 7,
    "payload": {"team_a_econ": 1, "team_b_econ": 2},
}


def sent_codes(spark, *changes, typed=True):
    lines = [json.dumps({k: v for k, v in {**LINE, **c}.items() if v != "absent"}) for c in changes]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    rows = intake.validate(intake.read_lines(frame, "i"), strict=True, typed=typed, sent="sent")
    return [r.errors for r in rows.orderBy("i").collect()]


def test_types_as_sent(spark):
    assert sent_codes(
        spark, {}, {"round_no": "3"}, {"seq_no": 7.0}, {"seq_no": 7.5}, {"source": 5}, {"trace_id": None},
        {"payload": json.dumps(LINE["payload"])}, {"ts_ingest": "absent"}, {"match_id": "absent"}, {"more": [1]},
    ) == [[], ["round_no"], ["seq_no"], ["seq_no"], ["source"], ["trace_id"], ["payload"], [], ["match_id"], []]


def test_payload_types_as_sent(spark):
    money = lambda **more: {"payload": {**LINE["payload"], **more}}
    assert sent_codes(
        spark, money(team_a_econ="1"), money(team_a_equipment_value="9"), money(team_a_equipment_value=9),
        money(team_b_buy_type=1), money(team_b_buy_type=None), money(unknown="x"), {"payload": {"team_a_econ": 1}},
    ) == [["payload.team_a_econ"], ["payload.team_a_equipment_value"], [], ["payload.team_b_buy_type"],
          ["payload.team_b_buy_type"], [], ["payload.team_b_econ"]]
    bomb = {"player_id": "p", "player_team": "A", "site": "B"}
    with_time = [{"type": "bomb_planted", "payload": {**bomb, "time_remaining_sec": x}} for x in (1.5, 3, "3", True)]
    late = ["payload.time_remaining_sec"]
    assert sent_codes(spark, *with_time) == [[], [], late, late]
    kill = {"killer_player_id": "a", "killer_team": "A", "victim_player_id": "b", "victim_team": "B", "weapon": "w"}
    flags = [{"is_headshot": "true"}, {"is_headshot": 1}, {"is_headshot": False}, {"is_headshot": True, "is_no_scope": "no"}]
    got = sent_codes(spark, *({"type": "kill", "payload": {**kill, **f}} for f in flags))
    assert got == [["payload.is_headshot"], ["payload.is_headshot"], [], ["payload.is_no_scope"]]


def test_lines_that_are_no_objects(spark):
    frame = spark.createDataFrame([(x,) for x in ("{not json", "[1]", "5", "", None)], "value string")
    rows = intake.validate(intake.read_lines(frame), strict=True, typed=True, sent="sent").collect()
    assert len(rows) == 5 and all("event_id" in r.errors and "payload" in r.errors for r in rows)


def test_batch_results(spark):
    def item(n, **change):
        return {**GOOD, "event_id": f"00000000-0000-4000-8000-{n:012d}", **change}

    batches = [
        (1, [item(1), item(2), item(1), item(3, seq_no="-4")]),
        (2, [item(2), item(4), item(5), item(6), item(7)]),  # too large
        (3, [item(4), item(3), item(4), item(9, event_id=None)]),
    ]
    frame = spark.createDataFrame(
        [(r, [tuple(i[n] for n in WIRE.names) for i in items]) for r, items in batches],
        StructType([StructField("request", LongType()), StructField("events", ArrayType(WIRE))]))
    items = intake.validate(intake.explode_batches(frame, limit=4))
    got = intake.batch_results(items, ["request", "pos"])
    short = {(r.request, r.pos): (r.success, r.duplicate, r.error) for r in got.collect()}
    taken, copy, large, bad = (True, False, None), (True, True, None), (False, False, "BATCH_TOO_LARGE"), (
        False, False, "Validation failed")
    assert short == {(1, 0): taken, (1, 1): taken, (1, 2): copy, (1, 3): bad, **{(2, i): large for i in range(5)},
                     (3, 0): taken, (3, 1): taken, (3, 2): copy, (3, 3): bad}
    totals = {r.request: (r.total, r.processed, r.duplicates, r.errors) for r in intake.batch_totals(got, "request").collect()}
    assert totals == {1: (4, 2, 1, 1), 2: (5, 0, 0, 5), 3: (4, 2, 1, 1)}
    assert got.filter("event_id = 'unknown'").count() == 1


def plain_ledger(times, most, life):
    out, count, first = [], 0, 0
    for at in times:
        if count == 0 or at >= first + life:
            count, first = 0, at
        count += 1
        out.append((at, count, first))
        count = 0 if count == most else count
    return out


@pytest.mark.parametrize("most,life", [(3, 100), (1, 100), (5, 40)])
def test_retry_counters(spark, most, life):
    rng = random.Random(most)
    events = {"busy": sorted(rng.randrange(6_000) for _ in range(1_500)), "rare": sorted(rng.sample(range(9_000), 40)),
              "mixed": sorted([rng.randrange(300) for _ in range(60)] + [rng.randrange(9_000) for _ in range(90)]),
              "ties": [50] * 7 + [149] * 2 + [150] * 4, "edge": [0, 100, 200, 299, 300], "one": [77]}
    rows = [(e, "s", t, i) for e, times in events.items() for i, t in enumerate(times)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "event_id string, shard string, failed_at long, failure_no long")
    got = {}
    for r in dead_letter.retry_ledger(frame, most, life).orderBy("event_id", "failed_at", "failure_no").collect():
        assert r.dead == (r.tries == most)
        got.setdefault(r.event_id, []).append((r.failed_at, r.tries, r.first_failed_at))
    assert got == {e: plain_ledger(times, most, life) for e, times in events.items()}


def test_shards_of_one_chunk_are_worked_through_at_once(spark, monkeypatch):
    """They are not summed up first; cut into chunks all the same they give the same."""
    pick = random.Random(8)
    order = sorted((s for s in range(1, 200) if pick.random() >= 0.05), key=lambda s: s + pick.random() * 12)
    rows = [("m", x, f"{x}{i}", s, i, 400 * i) for x in "ab" for i, s in enumerate(order)]
    rows += [("m", "c", f"c{i}", i + 1, i, 400 * i) for i in range(20)]
    frame = arrivals(spark, rows)

    def outcomes(chunk_rows):
        done = sequence.sequence_actions(frame, ["place"], F.floor(F.col("place") / 9), chunk_rows=chunk_rows)
        return sorted((tuple(r) for r in done.collect()), key=str)

    cut_up = outcomes(0)
    assert len(cut_up) == len(rows) and outcomes(50) == cut_up
    first = sequence._arrivals

    def fails(rows, carry):
        raise AssertionError("summed up")

    monkeypatch.setattr(sequence, "_arrivals", lambda rules: (fails, first(rules)[1]))
    assert outcomes(1000) == cut_up


def test_rejected_events_are_found_with_one_parse_of_the_payload(spark):
    """The filter on the errors stays behind them; in front it would parse the payload for each rule."""
    wire = spark.range(3).select(*(F.concat(F.lit(f"{c}-"), F.col("id").cast("string")).alias(c) for c in WIRE.names))
    bad = intake.quarantine(intake.split(intake.validate(wire, strict=True, typed=True, skew_ms=30_000))[1])
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert bad.count() == 3
