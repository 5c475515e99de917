"""A match of three rounds, worked out by hand, and the rules around it."""

import json
import time

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from matchflow.operators import dead_letter, dedup, evaluation, rollups, scoring
from matchflow.operators import state as st
from matchflow import schema as sc
from matchflow.schema import RAW

A, B = "team-a", "team-b"
IDS = {"team_a_id": A, "team_b_id": B}


def kill(team, number, victim, headshot=False, first=False):
    other = "B" if team == "A" else "A"
    return "kill", {"killer_player_id": f"{team}{number}", "killer_team": team, "victim_player_id": f"{other}{victim}",
                    "victim_team": other, "weapon": "rifle", "is_headshot": headshot, "is_first_kill": first, **IDS}


def begin(a, b):
    return "round_start", {"team_a_score": a, "team_b_score": b, "team_a_side": "CT", "team_b_side": "T", **IDS}


def end(winner, reason, a, b):
    return "round_end", {"winner_team": winner, "win_reason": reason, "team_a_score": a, "team_b_score": b, **IDS}


def bomb(kind, team, number, site):
    return kind, {"player_id": f"{team}{number}", "player_team": team, "site": site}


ROUNDS = [
    [begin(0, 0), kill("A", 1, 1, True), kill("A", 2, 2), end("A", "elimination", 1, 0)],
    [begin(1, 0), ("economy_update", {"team_a_econ": 16000, "team_b_econ": 4500}), bomb("bomb_planted", "B", 3, "A"),
     kill("A", 3, 3, True), bomb("bomb_defused", "A", 4, "A"), end("A", "bomb_defused", 2, 0)],
    [begin(2, 0), kill("B", 1, 1, True, True), kill("B", 2, 2), bomb("bomb_planted", "B", 4, "B"),
     end("B", "bomb_exploded", 2, 1)],
]


@pytest.fixture(scope="module")
def golden(spark):
    rows, seq = [], 0
    for number, events in enumerate(ROUNDS, 1):
        for kind, payload in events:
            seq += 1
            rows.append((f"e{seq:02d}", "m", "map", number, seq * 10_000, kind, seq, json.dumps(payload)))
    columns = "event_id string, match_id string, map_id string, round_no int, ms long, type string, seq_no long, payload string"
    frame = spark.createDataFrame(rows, columns)
    return frame.select(
        "event_id", "match_id", "map_id", "round_no", F.timestamp_millis("ms").alias("ts_event"),
        F.timestamp_millis("ms").alias("ts_ingest"), "type", F.lit("p").alias("source"), "seq_no", "payload",
        F.lit("").alias("trace_id"), F.col("ms").alias("version"),
    ).select(*RAW.names).cache()


def test_rounds(golden):
    rows = {r.round_no: r for r in rollups.round_metrics(golden).collect()}
    assert [rows[n].round_winner for n in (1, 2, 3)] == ["A", "A", "B"]
    assert [(rows[n].team_a_kills, rows[n].team_b_kills) for n in (1, 2, 3)] == [(2, 0), (1, 0), (0, 2)]
    assert [rows[n].team_a_headshots for n in (1, 2, 3)] == [1, 1, 0]
    assert rows[3].team_b_first_kills == 1
    assert (rows[3].team_a_score, rows[3].team_b_score) == (2, 1)
    assert rows[2].round_duration_sec == 50


def test_final_state(golden):
    last = st.final_state(st.match_state(golden)).first()
    assert (last.team_a.score, last.team_b.score, last.round_no, last.phase) == (2, 1, 3, "ended")
    assert (last.team_a.alive_count, last.team_b.alive_count) == (3, 5)
    assert (last.team_a.consecutive_round_losses, last.team_b.consecutive_round_losses) == (1, 0)
    assert (last.team_a.money, last.team_b.money, last.bomb_planted, last.seconds_remaining) == (16000, 4500, True, 40)
    assert last.state_version == 15


def test_probabilities(golden):
    scored = scoring.score(scoring.features(scoring.significant(st.match_state(golden))))
    p = {r.seq_no: (round(r.p_raw, 6), round(r.confidence, 6)) for r in scored.collect()}
    assert p[1] == (0.5, 0.1)  # five against five
    assert p[3] == (0.8, 0.2)  # two of team B are out
    assert p[4] == (0.82, 0.2)  # and team B lost a round
    assert p[7] == (0.27, 0.2)  # bomb down, team A defends
    assert p[8] == (0.42, 0.3)


def test_stats(golden):
    stats = {r.player_id: r for r in rollups.player_stats(golden).collect()}
    assert (stats["A1"].kills, stats["A1"].deaths, stats["A1"].headshots) == (1, 1, 1)
    assert (stats["B1"].kills, stats["B1"].deaths, stats["B1"].first_kills) == (1, 1, 1)
    teams = {r.team: r for r in rollups.team_match_stats(golden).collect()}
    assert (teams["A"].rounds_won, teams["B"].rounds_won, teams["A"].kills, teams["A"].deaths) == (2, 1, 3, 2)
    report = {r.round_no: r for r in rollups.round_report(golden).collect()}
    assert (report[2].win_reason, report[3].first_blood_player) == ("bomb_defused", "B1")


# What an event type sets anew for both teams, and the phase it leads to.
_RESETS = {"match_start": ("maps_won", 0), "map_start": ("score", 0), "round_start": ("alive_count", sc.PLAYERS)}
_PHASES = {
    "round_start": "live", "bomb_planted": "bomb_planted", "bomb_defused": "ended", "bomb_exploded": "ended",
    "round_end": "ended",
}
_OTHER = {"A": "B", "B": "A"}


def first_state(map_id: str, round_no: int, payload: dict) -> dict:
    def team(t: str) -> dict:
        return {
            "id": payload.get(f"team_{t}_id") or t.upper(), "score": 0, "maps_won": 0, "money": 0,
            "equipment_value": 0, "consecutive_round_losses": 0, "side": "CT", "alive_count": sc.PLAYERS,
        }

    return {"map_id": map_id, "round_no": round_no, "phase": "warmup", "bomb_planted": False, "seconds_remaining": 0,
            "state_version": 0, "A": team("a"), "B": team("b")}


def advance(state: dict, kind: str, map_id: str, round_no: int, payload: dict) -> None:
    """Bring the state of a match up to one more event."""
    teams = {t: state[t] for t in sc.TEAMS}
    state["state_version"] += 1
    state["round_no"] = 1 if kind == "map_start" else max(state["round_no"], round_no)
    state["phase"] = _PHASES.get(kind, state["phase"])
    if kind == "map_start":
        state["map_id"] = map_id
    if kind in _RESETS:
        name, value = _RESETS[kind]
        for team in teams.values():
            team[name] = value
    if kind in ("round_start", "bomb_planted"):
        state["bomb_planted"] = kind == "bomb_planted"
    if kind == "bomb_planted":
        state["seconds_remaining"] = sc.BOMB_SECONDS
    for t, team in teams.items():
        prefix = f"team_{t.lower()}_"
        if kind == "round_start":
            team["side"] = payload.get(prefix + "side") or team["side"]
        if kind == "economy_update":
            for name, field in (("money", "econ"), ("equipment_value", "equipment_value")):
                if isinstance(payload.get(prefix + field), (int, float)):
                    team[name] = int(payload[prefix + field])
    victim, winner = payload.get("victim_team"), payload.get("winner_team")
    if kind == "kill" and victim in teams:
        teams[victim]["alive_count"] = max(0, teams[victim]["alive_count"] - 1)
    if kind == "map_end" and winner in teams:
        teams[winner]["maps_won"] += 1
    if kind == "round_end" and winner in teams:
        teams[winner]["score"] += 1
        teams[winner]["consecutive_round_losses"] = 0
        teams[_OTHER[winner]]["consecutive_round_losses"] += 1


def flat_state(r):
    return (r.state_version, r.round_no, r.phase, r.map_id, r.bomb_planted, r.seconds_remaining, *(
        getattr(t, f) for t in (r.team_a, r.team_b)
        for f in ("id", "score", "maps_won", "money", "equipment_value", "consecutive_round_losses", "side", "alive_count")))


def folded_state(events):
    known, out = None, {}
    for r in sorted(events, key=lambda r: r.seq_no):
        payload = json.loads(r.payload)
        known = known or first_state(r.map_id, r.round_no, payload)
        advance(known, r.type, r.map_id, r.round_no, payload)
        out[r.seq_no] = (
            known["state_version"], known["round_no"], known["phase"], known["map_id"], known["bomb_planted"],
            known["seconds_remaining"], *(known[t][f] for t in "AB" for f in (
                "id", "score", "maps_won", "money", "equipment_value", "consecutive_round_losses", "side", "alive_count")))
    return out


def test_batch_state_equals_the_fold(golden):
    rows = st.match_state(golden, chunk_rows=4).collect()
    assert {r.seq_no: flat_state(r) for r in rows} == folded_state(golden.collect())


@pytest.mark.parametrize("cut", [1, 3, 8, 12])
def test_state_goes_on_from_an_earlier_one(golden, cut):
    """Events after a cut, put on the state before it, give what all events give."""
    extra = golden.withColumns({
        "match_id": F.lit("n"), "event_id": F.concat(F.lit("n"), "event_id"),
        "type": F.when(F.col("seq_no") == 6, "map_start").when(F.col("seq_no") == 11, "match_start").when(
            F.col("seq_no").isin(5, 9), "map_end").otherwise(F.col("type")),
    })
    both = golden.unionByName(extra)
    whole = {(r.match_id, r.seq_no): flat_state(r) for r in st.match_state(both).collect()}
    first = st.match_state(both.filter(F.col("seq_no") <= cut))
    later = st.match_state(both.filter(F.col("seq_no") > cut), before=st.final_state(first).select(*first.columns))
    assert {(r.match_id, r.seq_no): flat_state(r) for r in later.collect()} == {k: v for k, v in whole.items() if k[1] > cut}
    assert {k: v for k, v in whole.items() if k[0] == "n"} == {
        ("n", k): v for k, v in folded_state(extra.collect()).items()}


def test_limiter_goes_on_from_an_earlier_value(spark):
    rows = wild(spark, 60).cache()
    whole = {r.state_version: r.p_team_a_win for r in scoring.limit_swing(rows).collect()}
    first = scoring.limit_swing(rows.filter("state_version <= 33"))
    before = first.filter("state_version = 33").select("match_id", F.unix_millis("ts_event").alias("ms"), F.col("p_team_a_win").alias("p"))
    later = scoring.limit_swing(rows.filter("state_version > 33"), chunk_rows=9, before=before).collect()
    assert len(later) == 26
    assert all(r.p_team_a_win == pytest.approx(whole[r.state_version]) for r in later)


def test_streaks_and_ratings(spark, golden):
    rows = st.win_streaks(rollups.round_metrics(golden), chunk_rows=2).orderBy("round_no").collect()
    assert [(r.streak_team, r.streak_length) for r in rows] == [("A", 1), ("A", 2), ("B", 1)]
    strength = spark.createDataFrame([(A, 1250)], "id string, rating int")
    first = scoring.features(st.match_state(golden, strength)).orderBy("seq_no").first()
    assert first.strength_diff == 0.5


def test_merged_partials_equal_direct(golden):
    columns = [c for c in rollups.round_metrics(golden).columns]
    direct = rollups.round_metrics(golden).select(columns)
    merged = rollups.merged_rounds(rollups.round_partials(golden, F.col("seq_no") % 4)).select(columns)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, merged.collect()))


def test_copies_do_not_count(golden):
    twice = golden.unionByName(golden.withColumn("version", F.col("version") + 1))
    once = dedup.dedup_latest(twice, dedup.RAW_KEY, ["version"])
    assert once.count() == golden.count()
    assert once.agg(F.sum("version")).first()[0] == golden.agg(F.sum(F.col("version") + 1)).first()[0]
    again = dedup.dedup_latest(once, dedup.RAW_KEY, ["version"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_history_pages_keep_all_points(spark):
    pred = spark.range(1, 58).select(
        F.lit("m").alias("match_id"), F.lit("x").alias("map_id"), F.col("id").alias("state_version"),
        F.timestamp_millis(F.col("id") * 1000).alias("ts_calc"), F.lit(1).alias("round_no"),
        F.lit(0.5).alias("p_team_a_win"), F.lit(0.5).alias("p_team_b_win"), F.lit(0.1).alias("confidence"),
        F.lit("kill").alias("trigger_event_type"), F.lit(A).alias("team_a_id"), F.lit(B).alias("team_b_id"),
    )
    pages = evaluation.prediction_history_doc(pred, page=20).orderBy("page").collect()
    assert [len(p.points) for p in pages] == [20, 20, 17]
    assert [x.state_version for p in pages for x in p.points] == list(range(1, 58))


def test_requeue_brings_each_event_once(golden):
    letters = golden.filter("seq_no <= 3").withColumn("shard", F.lit("m:map"))
    back = dead_letter.requeue(golden.filter("seq_no > 2"), letters)
    assert back.count() == golden.count()
    assert back.filter("requeued").count() == 2


def limited_by_hand(points):
    """The limiter one prediction after the other."""
    last, out = None, []
    for ms, p in points:
        if last and ms > last[0]:
            dt, gap = (ms - last[0]) / 1000, abs(p - last[1])
            if gap > 0.2 * dt + 0.05:
                step = min(gap, 0.2 + 0.05 * dt)
                p = max(0.01, min(0.99, last[1] + (step if p > last[1] else -step)))
        last = (ms, p)
        out.append(p)
    return out


def wild(spark, n):
    """Swings that never let the limiter rest, in one match."""
    i = F.col("id")
    return spark.range(1, n).select(
        F.lit("m").alias("match_id"), i.alias("state_version"),
        F.timestamp_millis(i * 100 + F.when(i % 50 == 0, 30).otherwise(0)).alias("ts_event"),
        F.when(i % 2 == 0, 0.95 - (i % 113) / 1000).otherwise(0.05 + (i % 89) / 2000).alias("p_raw"),
    )


def points_of(rows):
    return [(int(round(r.ts_event.timestamp() * 1000)), r.p_raw) for r in rows]


@pytest.mark.parametrize("chunk", [1, 3, 10, 1000])
def test_limiter_on_wild_swings(spark, chunk):
    rows = wild(spark, 400).cache()
    got = scoring.limit_swing(rows, chunk_rows=chunk).orderBy("state_version").collect()
    assert [r.p_team_a_win for r in got] == pytest.approx(limited_by_hand(points_of(rows.orderBy("state_version").collect())))
    assert sum(r.p_team_a_win != r.p_raw for r in got) > 200


def test_limiter_is_linear_on_a_long_limited_run(spark):
    """100,000 rows that are limited one after the other, in chunks that hand their value on."""
    rows = wild(spark, 100_001).repartition(8)
    start = time.perf_counter()
    got = scoring.limit_swing(rows, chunk_rows=5_000).toPandas().sort_values("state_version")
    assert time.perf_counter() - start < 60
    assert (got["p_team_a_win"] != got["p_raw"]).sum() > 50_000
    ms = ((got["ts_event"] - pd.Timestamp(0)) // pd.Timedelta("1ms")).tolist()
    want = limited_by_hand(list(zip(ms, got["p_raw"].tolist())))
    assert got["p_team_a_win"].tolist() == pytest.approx(want, abs=1e-9)


@given(st_.lists(st_.tuples(st_.integers(1, 3000), st_.floats(0.01, 0.99)), min_size=1, max_size=60),
       st_.lists(st_.floats(0.01, 0.99), min_size=1, max_size=20))
def test_composed_swing_maps_equal_the_rows(steps, starts):
    """The map of a run of rows gives what the rows give, for any value before them."""
    ms = [0]
    for dt, _ in steps:
        ms.append(ms[-1] + dt)
    ps = [0.5, *(p for _, p in steps)]
    free, allowed = scoring._limits(ms)
    pieces = scoring._SAME
    for p, f, a in zip(ps[1:], free, allowed):
        pieces = scoring._then(pieces, p, f, a)
    for x in starts:
        near = min(abs(x - at) for at, _, _ in pieces)
        want = scoring._published(x, ps, free, allowed)[-1]
        assert near < 1e-9 or scoring._value(pieces, x) == pytest.approx(want, abs=1e-9)
    assert len(pieces) <= 40


def test_rounds_are_aggregated_by_hash(spark, golden):
    """Only the few events that name a winner are sorted."""
    plan = rollups.round_metrics(golden)._jdf.queryExecution().optimizedPlan().toString()
    sums, picks = (part for part in plan.split("Aggregate [")[1:])
    assert "max_by" not in sums and "max_by" in picks and "round_end" in picks.split("Filter")[-1]


def test_latest_prediction_of_a_match_looks_up_what_it_shows(spark, tmp_path):
    """Wide columns of the predictions are not read, so they are not shuffled either."""
    rows = spark.range(8).select(
        (F.col("id") % 2).cast("string").alias("match_id"), F.timestamp_millis(F.col("id") * 1000).alias("ts_calc"),
        F.col("id").alias("state_version"), F.lit(1).alias("round_no"), (F.col("id") / 10).alias("p_team_a_win"),
        F.lit(0.5).alias("p_team_b_win"), F.lit(0.5).alias("confidence"), F.lit("wide").alias("features"),
        F.create_map(F.lit("x"), F.lit(1.0)).alias("components"))
    rows.write.parquet(f"{tmp_path}/p")
    matches = spark.createDataFrame([("0",), ("1",), ("2",)], "match_id string")
    got = evaluation.match_latest_prediction(matches, spark.read.parquet(f"{tmp_path}/p"))
    assert {(r.match_id, r.p_team_a_win) for r in got.collect()} == {("0", 0.6), ("1", 0.7), ("2", None)}
    assert "features" not in got._jdf.queryExecution().executedPlan().toString()


def test_stored_events_are_dealt_without_payloads(spark):
    from matchflow.sources import fixtures, store

    dealt = []

    def deal(rows, n):
        dealt.append((rows.columns, n))
        return store.by_range(rows, n)

    sf = "/root/testdata/sf0.001"
    got, want = fixtures.events(spark, sf, deal=deal), fixtures.events(spark, sf)
    assert "payload" not in dealt[0][0] and dealt[0][1] >= 1
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_matches_of_one_chunk_are_not_summed_up(spark, monkeypatch):
    from matchflow.operators import scoring

    rows = spark.range(1, 90).select(
        F.lit("m").alias("match_id"), F.col("id").alias("state_version"), F.timestamp_millis(F.col("id") * 300).alias("ts_event"),
        F.when(F.col("id") % 7 < 3, 0.1).otherwise(0.9).alias("p_raw"))
    want = sorted(map(tuple, scoring.limit_swing(rows, chunk_rows=10).collect()))

    def fails(rows, carry):
        raise AssertionError("summed up")

    monkeypatch.setattr(scoring, "_swing_summary", fails)
    assert sorted(map(tuple, scoring.limit_swing(rows).collect())) == want


def test_a_replay_ends_with_the_ends_of_chunks(spark):
    from matchflow.operators import state
    from matchflow.plans import tables

    raw = tables.events(spark, "/root/testdata/sf0.001")
    want = state.final_state(state.match_state(raw))
    got = state.final_state(state.match_state(raw, chunk_rows=9, ends_only=True))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert state.match_state(raw, ends_only=True).count() == want.count() < raw.count()
