"""One query per operator, over the driver's tables.

Outputs are flat: numbers, text, booleans and dates; times are epoch
milliseconds; shares and means are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import running as run
from matchflow.functions import scalars as fn
from matchflow.operators import (
    alerts, catalog, dead_letter, dedup, evaluation, intake, integrity, rollups, scoring, sequence, slo, usage,
)
from matchflow.operators import state as st
from matchflow.plans import tables
from matchflow.session import cut, prepare, shared_path
from matchflow.sources import fixtures as fx
from matchflow.sources import store
from matchflow.streaming import jobs
from matchflow.streaming import pipeline as pl
from matchflow.streaming.states import StateTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(prepare(spark), sf_dir)

    prepared.__name__, prepared.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = prepared
    return prepared


def ms(name: str, alias: str | None = None) -> Column:
    return F.unix_millis(name).alias(alias or name.removesuffix("_ts") + "_ms")


def r6(value: Column | str, alias: str | None = None) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6).alias(alias or value)


def big(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


ROUND = ["match_id", "map_id", "round_no"]
ARRIVAL = ["arrival_key", "event_id", "copy_no"]


def arrival_chunk() -> Column:
    return F.floor(F.col("arrival_key") / run.CHUNK_ROWS)


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.wire(fx.arrivals(tables.events(spark, sf_dir)))


# --- Sources, sinks, intake ---------------------------------------------------


@query
def raw_append_columns(spark, d):
    rows = store.raw_columns(tables.events(spark, d))
    return rows.select(
        "event_id", "match_id", "map_id", "seq_no", "type", "source", F.col("date").cast("string").alias("date"),
        ms("event_hour", "hour_ms"), "month", "ingest_day", "version", "trace_id",
    )


@query
def batch_outcomes(spark, d):
    return intake.batch_outcomes(intake.validate(received(spark, d)))


@query
def validate_envelope(spark, d):
    rows = intake.validate(received(spark, d))
    return rows.select("event_id", "match_id", "seq_no", F.concat_ws(",", "errors").alias("errors"))


@query
def validate_strict(spark, d):
    rows = intake.validate(received(spark, d), strict=True)
    return rows.select("event_id", "match_id", "seq_no", F.concat_ws(",", "errors").alias("errors"))


@query
def validate_payload(spark, d):
    rows = intake.validate(received(spark, d), typed=True)
    return rows.select("event_id", "match_id", "seq_no", F.concat_ws(",", "errors").alias("errors"))


@query
def validate_types(spark, d):
    """Lines whose fields were sent as another JSON type, among the other malformed ones."""
    wire = fx.wire(fx.arrivals(tables.events(spark, d)), "event_no", "k")
    rows = intake.read_lines(wire.select(fx.lines(wire, faults=True).alias("value")))
    rows = intake.validate(rows, typed=True, sent="sent")
    return rows.select("event_id", "match_id", "seq_no", F.concat_ws(",", "errors").alias("errors"))


def batch_items(spark, d) -> DataFrame:
    wire = fx.wire(fx.arrivals(tables.events(spark, d)), "event_no", "copy_no")
    items = intake.validate(intake.explode_batches(fx.requests(wire)), strict=True)
    return intake.batch_results(items, ["request_no", "pos"])


@query
def batch_results(spark, d):
    """The answer for every event of every request batch."""
    return batch_items(spark, d).select(big("request_no"), big("pos"), "event_id", "success", "duplicate", "error")


@query
def batch_totals(spark, d):
    rows = intake.batch_totals(batch_items(spark, d), "request_no")
    return rows.select(*(big(c) for c in ("request_no", "total", "processed", "duplicates", "errors")))


@query
def clock_skew(spark, d):
    rows = intake.validate(received(spark, d), skew_ms=30_000)
    return rows.select("event_id", "match_id", "seq_no", F.concat_ws(",", "errors").alias("errors"))


def bad_events(spark, d) -> DataFrame:
    return intake.split(intake.validate(received(spark, d), strict=True, typed=True, skew_ms=30_000))[1]


@query
def quarantine_rows(spark, d):
    rows = intake.quarantine(bad_events(spark, d))
    return rows.select("event_id", "shard", "error", "retry_count", "first_failed_at", "last_failed_at",
                       F.get_json_object("event", "$.seq_no").alias("event_seq_no"))


@query
def ingestion_errors(spark, d):
    resolved = F.col("seq_no").cast("long") % 3 == 0
    return intake.ingestion_errors(bad_events(spark, d), resolved)


@query
def processing_outcomes(spark, d):
    rows = intake.processing_outcomes(intake.validate(received(spark, d)))
    return rows.select("processor", "status", "events", r6("avg_latency_ms"))


@query
def export_match(spark, d):
    lines = store.export_lines(tables.events(spark, d))
    fields = ["event_id", "map_id", "type", "ts_event", "trace_id"]
    return lines.select("match_id", "seq_no", *(F.get_json_object("line", f"$.{f}").alias(f) for f in fields))


@query
def import_roundtrip(spark, d):
    path = shared_path(spark, "export")
    store.export_matches(tables.events(spark, d), path)
    rows = store.import_matches(spark, path)
    return rows.select("event_id", "match_id", "map_id", "round_no", "type", "source", "seq_no", ms("ts_event"),
                       ms("ts_ingest"))


@query
def training_dataset(spark, d):
    rows = store.training_dataset(tables.predictions(spark, d), evaluation.outcomes(tables.events(spark, d)))
    return rows.select("match_id", "map_id", "round_no", ms("ts_calc"), r6("p_team_a_win"),
                       F.get_json_object("features", "$.alive_diff").cast("double").alias("alive_diff"), "outcome")


@query
def webhook_outbox(spark, d):
    rows = usage.webhook_outbox(tables.predictions(spark, d), fx.api_clients(spark, d))
    return rows.select("match_id", "state_version", "recipients", "audience")


@query
def update_feed(spark, d):
    """State and prediction envelopes, read back from their JSON."""
    states = st.update_feed(
        tables.states(spark, d), "state", "ts_event", F.struct("state_version", "round_no", "phase")
    )
    preds = st.update_feed(
        tables.predictions(spark, d), "prediction", "ts_calc", F.struct("state_version", "round_no")
    )
    return states.unionByName(preds).select(
        "key", *(F.get_json_object("value", f"$.{f}").alias(f) for f in ("type", "match_id", "timestamp")),
        F.get_json_object("value", "$.data.state_version").cast("long").alias("state_version"),
        F.get_json_object("value", "$.data.phase").alias("phase"),
    )


# --- Filters ------------------------------------------------------------------


@query
def events_parsed(spark, d):
    rows = rollups.events_parsed(tables.events(spark, d))
    return rows.withColumn("ts_event_ms", F.unix_millis("ts_event")).withColumn(
        "date", F.col("date").cast("string")
    ).drop("ts_event")


@query
def significant_events(spark, d):
    return scoring.significant(tables.events(spark, d)).select("event_id", "match_id", "seq_no", "type")


@query
def live_matches_recent(spark, d):
    raw = tables.events(spark, d)
    as_of = raw.agg(F.max("ts_event").alias("t")).scalar()
    rows = rollups.live_matches_recent(rollups.match_metrics(raw), as_of)
    return rows.select("match_id", "map_id", "team_a_rounds_won", "team_b_rounds_won", "total_kills", "events_count",
                       ms("match_start_ts"), ms("last_event_ts"), big("seconds_since_last_event"))


@query
def retention(spark, d):
    log = fx.latency_log(spark, d).withColumn("date", F.to_date(F.timestamp_millis("ts_ms")))
    as_of = F.date_add(log.agg(F.max("date").alias("d")).scalar(), 10)
    return store.retain(log, "date", 30, as_of).select("event_id", "ts_ms")


@query
def tier_retention(spark, d):
    log = fx.audit_log(spark, d).withColumn("date", F.to_date(F.timestamp_millis("ts_ms")))
    tiers = fx.api_clients(spark, d).select(F.col("id").alias("client_id"), "tier")
    as_of = log.agg(F.max("date").alias("d")).scalar()
    rows = store.retain_by_tier(log.join(tiers, "client_id", "left"), "date", "tier", as_of)
    return rows.select("request_id", "client_id", "tier", "ts_ms")


@query
def scope_check(spark, d):
    needed = F.concat("action", F.lit(":matches"))
    rows = usage.scope_check(fx.audit_log(spark, d), fx.api_clients(spark, d), needed)
    return rows.select("request_id", "client_id", "needed", "allowed")


@query
def ip_allow(spark, d):
    rows = usage.ip_check(fx.audit_log(spark, d), fx.api_clients(spark, d))
    return rows.select("request_id", "client_id", "ip_address", "allowed")


@query
def match_search(spark, d):
    start, end = 788_918_400_000, 851_990_400_000  # 1995-01-01 to 1996-12-31
    rows = catalog.match_search(fx.matches(spark, d), "finished", 3, "tournament_1", start, end)
    return rows.select("id", "team_a_id", "team_b_id", "tournament", "scheduled_ms")


@query
def range_filters(spark, d):
    rows = evaluation.prediction_history(tables.predictions(spark, d), 2, 5)
    return rows.select("match_id", "state_version", "round_no", ms("ts_calc"), r6("p_team_a_win"))


@query
def events_in_range(spark, d):
    start, end = F.timestamp_millis(F.lit(1_704_067_800_000)), F.timestamp_millis(F.lit(1_704_069_000_000))
    rows = evaluation.events_between(tables.events(spark, d), start, end)
    return rows.select("event_id", "match_id", "seq_no", "type", ms("ts_event"))


# --- Joins --------------------------------------------------------------------


@query
def live_matches(spark, d):
    rows = catalog.live_matches(fx.matches(spark, d), fx.teams(spark, d))
    return rows.select("id", "format", "started_ms", "team_a_name", "team_b_name")


@query
def live_page(spark, d):
    rows = catalog.live_page(fx.matches(spark, d), fx.teams(spark, d))
    return rows.select("id", "started_ms", "team_a_name", "team_b_name", "place")


@query
def match_page_after(spark, d):
    """The page behind the cursor of place 40."""
    rows = catalog.page_after(fx.matches(spark, d), "NDA=", 20)
    return rows.select("id", "status", "place", "cursor", "total", "has_next_page")


@query
def prediction_curve(spark, d):
    """The curves of all matches."""
    rows = evaluation.prediction_curve(tables.predictions(spark, d))
    return rows.select("match_id", "state_version", ms("ts_calc"), r6("p_team_a_win"), "place")


@query
def rounds_in_order(spark, d):
    rows = rollups.round_metrics(tables.events(spark, d))
    return catalog.placed(rows, ["match_id", "map_id"], [F.col("round_no")]).select("match_id", "map_id", "round_no", "place")


@query
def players_by_kills(spark, d):
    rows = rollups.player_stats(tables.events(spark, d))
    order = [F.col("kills").desc(), F.col("player_id"), F.col("team")]
    return catalog.placed(rows, ["match_id", "map_id"], order).select("match_id", "map_id", "player_id", "team", "kills", "place")


@query
def types_by_count(spark, d):
    rows = rollups.event_counts(tables.events(spark, d))
    return catalog.placed(rows, ["match_id"], [F.col("events").desc(), F.col("type")])


@query
def match_details(spark, d):
    rows = catalog.match_details(fx.matches(spark, d), fx.teams(spark, d), fx.match_maps(spark, d))
    return rows.select("id", "status", "team_a_name", "team_b_name", "map_number", "map_name", "team_a_score",
                       "team_b_score")


@query
def match_document(spark, d):
    rows = catalog.match_document(fx.matches(spark, d), fx.teams(spark, d), fx.map_winners(spark, d))
    return rows.select("id", "team_a_name", "team_b_name", "winner_name", "status", F.posexplode_outer("maps")).select(
        "id", "team_a_name", "team_b_name", "winner_name", "status", F.col("pos").cast("long").alias("pos"),
        "col.map_number", "col.map_name", "col.team_a_score", "col.team_b_score", "col.map_winner",
    )


@query
def replay_diff(spark, d):
    """A replay that missed every 37th event against the live states."""
    raw = tables.events(spark, d)
    fields = ["score_a", "score_b", "round_no"]

    def last(rows):
        return st.final_state(st.match_state(rows, ends_only=True)).select(
            "match_id", F.col("team_a.score").alias("score_a"), F.col("team_b.score").alias("score_b"), "round_no"
        )

    lossy = fx.with_no(raw).filter("event_no % 37 <> 0").drop("event_no", "k")
    return st.replay_diff(last(lossy), last(raw), fields)


@query
def prediction_history_doc(spark, d):
    docs = evaluation.prediction_history_doc(tables.predictions(spark, d), page=10)
    return docs.select("match_id", "map_id", "page", "team_a_id", "team_b_id", "total_points",
                       F.posexplode("points")).select(
        "match_id", "map_id", "page", "team_a_id", "team_b_id", "total_points",
        F.col("pos").cast("long").alias("pos"), F.unix_millis("col.ts_calc").alias("ts_calc_ms"),
        F.round("col.p_team_a_win", 6).alias("p_team_a_win"), "col.trigger_event_type",
    )


@query
def match_latest_prediction(spark, d):
    every = tables.events(spark, d).groupBy("match_id").agg(F.count("*").alias("events"))
    rows = evaluation.match_latest_prediction(every, tables.predictions(spark, d))
    return rows.select("match_id", "events", ms("ts_calc"), "round_no", r6("p_team_a_win"))


@query
def key_audit(spark, d):
    tried = fx.audit_log(spark, d).select(
        "request_id",
        F.concat(F.lit("mk_"), F.lpad((F.col("client_id") + F.when(F.col("request_id") % 7 == 0, 100_000_000)
                                       .otherwise(0)).cast("string"), 8, "0")).alias("key_prefix"),
        F.concat(F.when(F.col("request_id") % 5 == 0, "wrong-").otherwise("secret-"),
                 F.col("client_id").cast("string")).alias("secret"),
    )
    rows = usage.key_audit(tried, fx.api_clients(spark, d))
    return rows.select("request_id", "key_prefix", "client_id", "valid")


def lossy_store(spark, d) -> tuple[DataFrame, DataFrame]:
    raw = tables.events(spark, d)
    arrived = fx.arrivals(raw)
    kept = fx.with_no(raw).filter("event_no % 37 <> 0")
    return arrived, kept


@query
def integrity_missing(spark, d):
    return integrity.missing_events(*lossy_store(spark, d)).select("match_id", "event_id", ms("first_received"))


@query
def integrity_ratio(spark, d):
    rows = integrity.match_integrity(*lossy_store(spark, d))
    return rows.select("match_id", big("received"), big("stored"), r6("stored_ratio"), "checksum_equal")


def players(spark, d) -> DataFrame:
    """Players seen in kills; the id tells the team."""
    stats = rollups.player_stats(tables.events(spark, d))
    number = F.substring("player_id", 25, 12).cast("long")
    return stats.select("player_id").distinct().select(
        F.col("player_id").alias("id"),
        F.concat(F.lit("player_"), number.cast("string")).alias("nickname"),
        F.when(number % 100 < 10, "A").otherwise("B").alias("team"),
    )


@query
def player_leaderboard(spark, d):
    rows = rollups.player_leaderboard(rollups.player_stats(tables.events(spark, d)), players(spark, d))
    return rows.select("match_id", "map_id", "player_id", "team", "kills", "deaths", "headshots", "first_kills",
                       "damage_dealt", "nickname", "home_team")


# --- Aggregates ---------------------------------------------------------------

ROUND_OUT = [
    *ROUND, *(f"team_{t}_{m}" for t in "ab" for m in ("kills", "headshots", "first_kills", "score")),
    "events_count", "round_winner",
]


def round_out(rows: DataFrame) -> DataFrame:
    return rows.select(*ROUND_OUT, ms("first_event_ts"), ms("last_event_ts"), F.col("date").cast("string").alias("date"),
                       "version")


@query
def round_metrics(spark, d):
    return round_out(rollups.round_metrics(tables.events(spark, d)))


@query
def round_metrics_merged(spark, d):
    """Partials of eight batches, merged."""
    raw = fx.with_no(tables.events(spark, d))
    return round_out(rollups.merged_rounds(rollups.round_partials(raw, F.col("event_no") % 8)))


@query
def match_metrics(spark, d):
    rows = rollups.match_metrics(tables.events(spark, d))
    return rows.select("match_id", "map_id", "total_rounds", "team_a_rounds_won", "team_b_rounds_won", "total_kills",
                       "team_a_kills", "team_b_kills", "total_headshots", "events_count", ms("match_start_ts"),
                       ms("last_event_ts"), "status", F.col("date").cast("string").alias("date"))


@query
def player_stats(spark, d):
    return rollups.player_stats(tables.events(spark, d))


@query
def player_round_stats(spark, d):
    return rollups.player_stats(tables.events(spark, d), by_round=True)


@query
def team_round_stats(spark, d):
    return rollups.team_round_stats(tables.events(spark, d))


@query
def match_timeline(spark, d):
    rows = rollups.match_timeline(tables.events(spark, d))
    return rows.select("match_id", ms("minute", "minute_ms"), "events_count", "kills_count")


@query
def event_counts(spark, d):
    return rollups.event_counts(tables.events(spark, d))


@query
def round_view(spark, d):
    rows = rollups.round_view(rollups.round_metrics(tables.events(spark, d)))
    return rows.withColumn("round_duration_sec", F.col("round_duration_sec").cast("long"))


@query
def match_summary(spark, d):
    rows = rollups.match_summary(tables.events(spark, d))
    return rows.select("match_id", "map_id", "team_a_rounds", "team_b_rounds", "team_a_total_kills",
                       "team_b_total_kills", r6("team_a_hs_percentage"), r6("team_b_hs_percentage"),
                       r6("avg_round_duration_sec"), "status")


@query
def round_enriched(spark, d):
    rows = rollups.round_enriched(tables.events(spark, d))
    return rows.select(*ROUND, "round_winner", "team_a_econ", "team_b_econ", "first_blood_team", r6("momentum"),
                       r6("economy_pressure"), "current_half")


@query
def win_streaks(spark, d):
    rows = st.win_streaks(rollups.round_metrics(tables.events(spark, d)))
    return rows.select(*ROUND, "round_winner", "streak_team", "streak_length")


@query
def round_report(spark, d):
    rows = rollups.round_report(tables.events(spark, d))
    return rows.withColumn("round_duration_sec", F.col("round_duration_sec").cast("long"))


@query
def team_match_stats(spark, d):
    rows = rollups.team_match_stats(tables.events(spark, d))
    return rows.select("match_id", "team", "rounds_won", "kills", "deaths", r6("headshot_percentage"),
                       r6("first_kill_rate"), r6("avg_economy"), r6("damage_per_round"))


@query
def weapon_stats(spark, d):
    return rollups.weapon_stats(tables.events(spark, d))


@query
def brier(spark, d):
    rows = evaluation.brier(tables.predictions(spark, d), evaluation.outcomes(tables.events(spark, d)))
    return rows.select(r6("brier_score"), "predictions")


@query
def calibration(spark, d):
    rows = evaluation.calibration(tables.predictions(spark, d), evaluation.outcomes(tables.events(spark, d)))
    return rows.select("bin", r6("avg_probability"), r6("win_rate"), "predictions")


@query
def model_quality(spark, d):
    """Quality of the active models, as of the last event."""
    raw = tables.events(spark, d)
    as_of = raw.agg(F.max("ts_event").alias("t")).scalar()
    rows = evaluation.model_quality(tables.predictions(spark, d), evaluation.outcomes(raw), as_of)
    models = tables.predictions(spark, d).select("model_version").distinct().select(
        "model_version", F.concat(F.lit("rules "), F.col("model_version")).alias("model_name"),
        F.lit(True).alias("is_active"),
    )
    return evaluation.active_models(rows, models).select(
        "model_version", "model_name", r6("accuracy"), r6("log_loss"), r6("brier_score"), r6("recent_accuracy"),
        "predictions", "drift_alarm",
    )


@query
def team_form(spark, d):
    rows = catalog.team_form(fx.matches(spark, d))
    return rows.select("team_id", "played", "wins", "losses", r6("win_rate"))


@query
def recent_matches(spark, d):
    return catalog.recent_matches(fx.matches(spark, d)).select(
        "team_id", "id", "opponent_id", "winner_id", "finished_ms", big("place")
    )


@query
def match_status_counts(spark, d):
    return catalog.status_counts(fx.matches(spark, d))


@query
def latest_prediction(spark, d):
    rows = evaluation.latest_prediction(tables.predictions(spark, d))
    return rows.select("match_id", "map_id", ms("ts_calc"), "state_version", r6("p_team_a_win"), r6("p_team_b_win"))


def dead_letters(spark, d) -> DataFrame:
    return intake.quarantine(bad_events(spark, d))


@query
def dlq_stats(spark, d):
    return dead_letter.dlq_stats(dead_letters(spark, d))


@query
def dlq_entries(spark, d):
    rows = dead_letter.dlq_entries(dead_letters(spark, d).dropDuplicates(["shard", "event_id"]), limit=3)
    return rows.select("shard", "event_id", big("place"))


@query
def retry_exhausted(spark, d):
    """Attempts that failed: none to five per event, depending on ``k``."""
    seen = fx.with_no(tables.events(spark, d))
    tries = seen.withColumn("attempt", F.explode(F.array_repeat(F.lit(1), F.col("k") % 6)))
    failures = tries.select(
        "event_id", F.concat_ws(":", "match_id", "map_id").alias("shard"),
        (F.unix_millis("ts_ingest") + F.col("attempt")).alias("failed_at"),
    )
    return dead_letter.retry_exhausted(failures)


@query
def retry_counters(spark, d):
    """Every failure of a match as one that is tried again and again, with the count it reached within an hour."""
    rows = dead_letter.retry_ledger(fx.failures(spark, d))
    return rows.select("event_id", "shard", "failed_at", "failure_no", "tries", "first_failed_at", "dead")


@query
def requeue(spark, d):
    """Repaired dead letters back among the stored events, one of them known already."""
    raw = fx.with_no(tables.events(spark, d))
    base = [c for c in raw.columns if c not in ("event_no", "k")]
    stored = raw.filter("event_no % 11 <> 0").select(base)
    letters = raw.filter("event_no % 11 = 0 OR event_no % 13 = 0").select(
        *base, F.concat_ws(":", "match_id", "map_id").alias("shard")
    )
    return dead_letter.requeue(stored, letters).select("event_id", "match_id", "seq_no", "requeued")


# --- Windows and sequences ----------------------------------------------------


@query
def dedup_first(spark, d):
    rows = dedup.dedup_first(fx.arrivals(tables.events(spark, d)), ["event_id"], ["arrival_key", "copy_no"])
    return rows.select("event_id", "match_id", "seq_no", "copy_no", "version")


@query
def dedup_latest(spark, d):
    rows = dedup.dedup_latest(fx.arrivals(tables.events(spark, d)), dedup.RAW_KEY, ["version", "ts_ingest", "copy_no"])
    return rows.select("event_id", "match_id", "map_id", "round_no", ms("ts_event"), "version", "copy_no")


@query
def sequence_gaps(spark, d):
    rows = sequence.sequence_gaps(fx.arrivals(tables.events(spark, d)), ARRIVAL, arrival_chunk())
    return rows.select("match_id", "map_id", "event_id", "copy_no", "seq_no", "gap")


@query
def late_events(spark, d):
    rows = sequence.late_events(fx.arrivals(tables.events(spark, d)), ARRIVAL, arrival_chunk())
    return rows.select("match_id", "map_id", "event_id", "copy_no", "seq_no", big("age_ms"), "action")


def actions(spark, d) -> DataFrame:
    arrived = dedup.dedup_first(fx.arrivals(tables.events(spark, d)), ["event_id"], ["arrival_key", "copy_no"])
    return sequence.sequence_actions(arrived, ["arrival_key", "event_id"], arrival_chunk())


@query
def sequence_actions(spark, d):
    return actions(spark, d).select("match_id", "map_id", "event_id", "seq_no", "arrival_no", "action", "outcome")


@query
def sequence_stats(spark, d):
    return sequence.sequence_stats(actions(spark, d))


def state_out(rows: DataFrame) -> DataFrame:
    teams = [
        F.col(f"team_{t}.{f}").cast("string" if f == "side" else "long").alias(f"{t}_{f}")
        for t in "ab"
        for f in ("score", "maps_won", "money", "equipment_value", "consecutive_round_losses", "side", "alive_count")
    ]
    return rows.select("match_id", "map_id", big("state_version"), "round_no", "phase", "bomb_planted",
                       "seconds_remaining", *teams)


@query
def match_state(spark, d):
    return state_out(tables.states(spark, d))


@query
def replay_final_state(spark, d):
    return state_out(st.final_state(st.match_state(tables.events(spark, d), ends_only=True)))


@query
def monotone_updates(spark, d):
    """State updates delivered in jittered order: stale ones are left out."""
    updates = fx.arrivals(tables.events(spark, d)).withColumn("state_version", F.col("seq_no"))
    rows = st.newer_updates(updates, "match_id", "state_version", ARRIVAL, arrival_chunk())
    return rows.select("match_id", "state_version", "copy_no")


@query
def swing_flags(spark, d):
    rows = scoring.swing_flags(tables.predictions(spark, d).withColumnRenamed("ts_calc", "ts_event"), p="p_team_a_win")
    return rows.select("match_id", big("state_version"), r6("dt_seconds"), r6("p_move"), "is_jump")


@query
def sliding_rate(spark, d):
    """Requests of the client in the last hour (calls are minutes apart here)."""
    rows = usage.sliding_rate(fx.audit_log(spark, d), 3_600_000)
    return rows.select("request_id", "client_id", "ts_ms", "requests_in_window")


@query
def sliding_rate_minute(spark, d):
    rows = usage.sliding_rate(fx.audit_log(spark, d))
    return rows.select("request_id", "client_id", "ts_ms", "requests_in_window")


@query
def effective_flags(spark, d):
    """Every call of the API checks the flag of one nation or an unknown one."""
    calls = fx.audit_log(spark, d)
    checks = calls.select("request_id", "client_id", F.concat(
        F.lit("NATION_"), ((F.col("client_id") * 7 + F.col("request_id")) % 27).cast("string")).alias("name"))
    rows = usage.effective_flags(checks, fx.feature_flags(spark, d))
    return rows.select("request_id", "client_id", "name", "is_enabled")


@query
def trim_shard(spark, d):
    """The newest twenty events of every shard (the feature's bound, made small)."""
    chunk = st.seq_chunk()
    rows = dead_letter.trim_shard(tables.events(spark, d), ["match_id", "map_id"], ["seq_no"], chunk, 20)
    return rows.select("match_id", "map_id", "seq_no", "event_id")


@query
def queue_lag(spark, d):
    rows = slo.queue_lag(tables.events(spark, d), F.unix_millis("ts_event"), F.unix_millis("ts_ingest"))
    return rows.select("event_id", big("lag_ms"))


@query
def shard_backlog(spark, d):
    """Events per shard and how far its newest one lies back."""
    raw = tables.events(spark, d)
    now = F.unix_millis(raw.agg(F.max("ts_ingest").alias("t")).scalar())
    return raw.groupBy("match_id", "map_id").agg(
        F.count("*").alias("backlog"), F.max(F.unix_millis("ts_ingest")).alias("newest_ms")
    ).withColumn("behind_ms", now - F.col("newest_ms"))


# --- Lists and pages ----------------------------------------------------------


@query
def match_page(spark, d):
    rows = catalog.match_page(fx.matches(spark, d), limit=20, offset=40)
    return rows.select("id", "status", big("place"), "cursor", "total", "has_next_page")


@query
def teams_by_rating(spark, d):
    return catalog.teams_by_rating(fx.teams(spark, d), 20, 5)


@query
def prediction_history(spark, d):
    rows = evaluation.prediction_history(tables.predictions(spark, d))
    return rows.select("match_id", "map_id", "state_version", ms("ts_calc"), "round_no", r6("p_team_a_win"),
                       r6("p_team_b_win"), r6("confidence"), "trigger_event_type")


@query
def prediction_latest_n(spark, d):
    rows = evaluation.latest_n(tables.predictions(spark, d), ["match_id"], ["ts_calc", "state_version"], 5)
    return rows.select("match_id", "state_version", ms("ts_calc"), r6("p_team_a_win"), big("place"))


@query
def last_events(spark, d):
    rows = catalog.last_events(tables.events(spark, d), 20)
    return rows.select("match_id", "event_id", "seq_no", "type", big("place"))


@query
def audit_recent(spark, d):
    return usage.audit_recent(fx.audit_log(spark, d), 10).select("client_id", "request_id", "ts_ms", "action",
                                                                  big("place"))


# --- Predictions --------------------------------------------------------------


@query
def features(spark, d):
    rows = scoring.features(tables.states(spark, d))
    return rows.select("match_id", big("state_version"), r6("econ_diff"), r6("equip_diff"), "round_no",
                       F.col("team_a.score").cast("long").alias("team_a_score"),
                       F.col("team_b.score").cast("long").alias("team_b_score"), big("alive_diff"), "bomb_planted",
                       big("win_streak_a"), big("win_streak_b"), r6("strength_diff"))


@query
def rule_prediction(spark, d):
    rows = scoring.score(scoring.features(tables.states(spark, d)))
    return rows.select("match_id", big("state_version"), r6("p_raw"), r6("confidence"), "model_version")


@query
def limited_prediction(spark, d):
    """Scored, limited and priced from the states on (not read from the store)."""
    return prediction_out(scoring.predictions(tables.states(spark, d)))


@query
def scalar_functions(spark, d):
    """Clamping, odds, cursors, hashes and texts over every event's value."""
    value = F.col("value")
    p = value / 560
    src = fx.table(spark, d, "events").select("event_id", "value", "event_type")
    return src.select(
        F.col("event_id").cast("long").alias("event_id"),
        r6(fn.safe_probability(F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(p)), "safe_p"),
        fn.decimal_odds(p, 0.05).alias("decimal_odds"),
        fn.american_odds(F.floor(value * 4) / 8 + 1.125).alias("american_odds"),
        fn.cursor(F.col("event_id")).alias("cursor"),
        fn.cursor_offset(fn.cursor(F.col("event_id"))).alias("cursor_offset"),
        F.sha2(F.col("event_type").cast("binary"), 256).alias("sha"),
        F.upper("event_type").alias("upper_type"),
        fn.score_text(F.floor(value), F.col("event_id")).alias("score_text"),
        fn.latency_status(value).alias("latency_status"),
        fn.error_status(value / 1000).alias("error_status"),
    )


# --- Objectives and usage -----------------------------------------------------


@query
def latency_slo(spark, d):
    rows = slo.latency_slo(fx.latency_log(spark, d), 3_600_000)
    return rows.select("bucket_ms", "total_events", "met_slo", r6("slo_percentage"), r6("p50_ms"), r6("p95_ms"),
                       r6("p99_ms"), r6("max_ms"))


@query
def latency_slo_minute(spark, d):
    rows = slo.latency_slo(fx.latency_log(spark, d))
    return rows.select("bucket_ms", "total_events", "met_slo", r6("slo_percentage"), r6("p50_ms"), r6("p95_ms"),
                       r6("p99_ms"), r6("max_ms"))


@query
def latency_sketch(spark, d):
    """Quantiles per hour from the stored sketch of each minute, as far as bands tell."""
    minutes = cut(slo.latency_sketch(slo.latency_partials(fx.latency_log(spark, d))))
    rows = slo.latency_rollup(minutes, 3_600_000, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return rows.select("bucket_ms", r6("p50_ms"), r6("p95_ms"), r6("p99_ms"))


@query
def stage_latency(spark, d):
    return slo.stage_latency(fx.latency_log(spark, d)).select("stage", r6("p95_ms"))


@query
def slo_status(spark, d):
    rows = slo.slo_status(fx.latency_log(spark, d))
    return rows.select("bucket_ms", "events", r6("compliance_percent"), r6("p95_ms"), "status")


@query
def latency_histogram(spark, d):
    from matchflow.schema import LATENCY_BUCKETS_MS

    rows = slo.histogram(fx.latency_log(spark, d), "e2e_ms", ["event_type"], LATENCY_BUCKETS_MS)
    finite = F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le"))
    return rows.select("event_type", finite.alias("le"), "cumulative", "count", F.round("sum", 3).alias("sum"))


@query
def histogram_quantile(spark, d):
    from matchflow.schema import LATENCY_BUCKETS_MS

    hist = slo.histogram(fx.latency_log(spark, d), "e2e_ms", ["event_type"], LATENCY_BUCKETS_MS)
    return slo.histogram_quantile(hist, ["event_type"], 0.95).select("event_type", r6("quantile"))


@query
def error_rate(spark, d):
    rows = slo.error_rate(fx.audit_log(spark, d))
    return rows.select("bucket_ms", "requests", "errors", r6("error_percent"), "status")


@query
def error_budget(spark, d):
    rows = slo.error_budget(fx.audit_log(spark, d).withColumn("service", F.lit("gateway")))
    return rows.select("service", "hour_ms", "requests", "errors", r6("allowed_errors"), r6("consumed"), "fast_burn",
                       "slow_burn")


@query
def throughput(spark, d):
    rows = slo.throughput(tables.events(spark, d), F.unix_millis("ts_event"), "type")
    return rows.select("bucket_ms", "type", "events", r6("per_second"))


@query
def prediction_throughput(spark, d):
    rows = slo.throughput(tables.predictions(spark, d), F.unix_millis("ts_calc"), "model_version")
    return rows.select("bucket_ms", "model_version", "events")


@query
def alert_runs(spark, d):
    """Hours in a row with more than 1 % server errors."""
    hours = slo.error_rate(fx.audit_log(spark, d), 3_600_000).select(
        F.lit("gateway").alias("service"), (F.col("bucket_ms") / 3_600_000).cast("long").alias("step"), "error_percent"
    )
    rows = slo.alert_runs(hours, ["service"], "step", F.col("error_percent") > 1, 2)
    return rows.select("service", "run_start", "run_length")


@query
def latency_alert_runs(spark, d):
    """Hours in a row with a p95 latency over 500 ms."""
    hours = slo.slo_status(fx.latency_log(spark, d), 3_600_000).select(
        F.lit("pipeline").alias("service"), (F.col("bucket_ms") / 3_600_000).cast("long").alias("step"), "p95_ms"
    )
    rows = slo.alert_runs(hours, ["service"], "step", F.col("p95_ms") > 500, 5)
    return rows.select("service", "run_start", "run_length")


# Thresholds that suit the few requests a minute of the given tables.
ALERTS = {
    **alerts.RULES,
    "consumer_lag": alerts.Rule("critical", 4.0, 1),
    "rate_limit_spike": alerts.Rule("warning", 0.02, 1),
    "invalid_signatures": alerts.Rule("warning", 0.01, 1),
}


def alert_series(spark, d) -> DataFrame:
    samples = cut(fx.scrapes(spark, d))
    return alerts.rates(samples, samples.filter("metric <> 'lag'").agg(F.max("step").alias("t")).scalar())


@query
def alert_values(spark, d):
    """What the alert rules look at, by service and minute."""
    return alert_series(spark, d).select("rule", "service", big("step"), r6("value"))


@query
def alert_rules(spark, d):
    """Pending and firing runs of all five rules."""
    rows = alerts.alerts(alert_series(spark, d), ALERTS)
    return rows.select("rule", "severity", "service", big("pending_from"), big("firing_from"), big("last_step"), r6("peak"))


@query
def rate_limited_clients(spark, d):
    return slo.rate_limited_clients(fx.audit_log(spark, d))


@query
def quota_usage(spark, d):
    rows = usage.quota_usage(fx.audit_log(spark, d), fx.api_clients(spark, d))
    return rows.select("client_id", "month", "tier", "used", "quota", r6("share"))


@query
def api_usage(spark, d):
    rows = usage.api_usage(fx.audit_log(spark, d))
    return rows.select("client_id", "action", "calls", "ok", "client_errors", "server_errors", r6("avg_ms"),
                       r6("p50_ms"), r6("p95_ms"))


@query
def replay_cursors(spark, d):
    rows = integrity.replay_cursors(tables.events(spark, d))
    return rows.select("match_id", "source", "last_seq_no", ms("last_event_ts"))


@query
def system_summary(spark, d):
    rows = slo.system_summary(
        spark, tables.events(spark, d), tables.predictions(spark, d), fx.matches(spark, d), fx.latency_log(spark, d),
        fx.audit_log(spark, d),
    )
    return rows.select("events", "predictions", "active_matches", r6("avg_latency_ms"), r6("error_rate"))


# --- Streams (run to the end, then read from their sinks) ---------------------


def taken_in(spark, d) -> DataFrame:
    return pl.raw_table(spark, jobs.intake(spark, d)).read()


@query
def intake_stream(spark, d):
    """Valid events stored by the intake job, each once."""
    rows = taken_in(spark, d)
    return rows.select("event_id", "match_id", "map_id", "round_no", "type", "source", "seq_no", ms("ts_event"))


@query
def stream_quarantine(spark, d):
    """Rejected lines, those that are no JSON included."""
    rows = spark.read.parquet(f"{jobs.intake(spark, d)}/quarantine")
    return rows.select("event_id", "shard", "error", "first_failed_at")


@query
def stream_dedup(spark, d):
    """Rows that the batches of the intake job wrote per event, before any merge: one each."""
    rows = pl.raw_table(spark, jobs.intake(spark, d)).deltas()
    return rows.groupBy("match_id", "event_id").agg(F.count("*").alias("copies"))


@query
def stream_late(spark, d):
    """Events that came hours after their time: new ones are stored, the others were stored before."""
    repeats = spark.read.parquet(f"{jobs.intake(spark, d)}/repeats")
    new = taken_in(spark, d).filter("late").select("event_id", "match_id", "month", F.lit("stored").alias("outcome"))
    return new.unionByName(repeats.select("event_id", "match_id", "month", F.lit("repeat").alias("outcome")))


@query
def stream_conservation(spark, d):
    """Every received row is stored, stored late, quarantined or a duplicate."""
    out = jobs.intake(spark, d)
    return pl.conservation(spark, out, spark.read.parquet(f"{out}/observed")).select(
        *(big(c) for c in ("received", "stored", "late", "quarantined", "duplicate")))


@query
def stream_raw_by_month(spark, d):
    """Streamed events of each month, read by month."""
    table = pl.raw_table(spark, jobs.intake(spark, d))
    rows = [table.read([month]) for month in table.open_months()]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("month").agg(
        F.count("*").alias("events"), F.sum("version").alias("versions"), F.max("seq_no").alias("last_seq_no"))


def settled(spark, d) -> DataFrame:
    return spark.read.parquet(f"{jobs.sequence(spark, d)}/actions")


@query
def stream_sequence(spark, d):
    """Outcome of every live event that has settled."""
    return settled(spark, d).select("match_id", "map_id", "event_id", "seq_no", "action", "outcome")


@query
def stream_expiry(spark, d):
    """Events that waited too long for a number before theirs, given out by timer or clock."""
    rows = settled(spark, d).filter("outcome = 'expired'")
    return rows.select("match_id", "map_id", "event_id", "seq_no", "since_ms")


@query
def live_sequence(spark, d):
    """The batch form over the same live events, up to the watermark the stream ends with."""
    rows = fx.live(tables.events(spark, d)).withColumn("arrived_ms", F.unix_millis("ts_ingest"))
    end = rows.agg(F.max("arrived_ms").alias("t")).scalar() - 10_000
    done = sequence.sequence_actions(rows, ["arrived_ms", "event_id"], F.floor(F.col("arrived_ms") / 60_000), until_ms=end)
    return done.select("match_id", "map_id", "event_id", "seq_no", "arrival_no", "action", "outcome")


def state_tables(spark, d) -> StateTables:
    return StateTables(spark, jobs.states(spark, d))


@query
def stream_state(spark, d):
    """States streamed from events in order of arrival; equal to the batch ones."""
    return state_out(state_tables(spark, d).states.read())


def prediction_out(rows: DataFrame) -> DataFrame:
    return rows.select("match_id", "map_id", big("state_version"), "round_no", r6("p_raw"), r6("p_team_a_win"),
                       r6("p_team_b_win"), r6("confidence"), "limited", "odds_a", "odds_b", "trigger_event_type",
                       "team_a_id", "team_b_id")


@query
def prediction_stream(spark, d):
    """Streamed predictions; equal to the batch ones in all columns."""
    return prediction_out(state_tables(spark, d).predictions.read())


@query
def stream_prediction_table(spark, d):
    """What the streamed prediction table keeps besides: time, model, parts of the score, prices."""
    rows = state_tables(spark, d).predictions.read()
    part = lambda name: r6(F.col("components")[name], f"part_{name}")
    return rows.select("match_id", "trigger_event_id", ms("ts_calc"), "model_version", "month",
                       *(part(n) for n in ("alive_diff", "equip_diff", "bomb", "odds_a", "odds_b")),
                       big("american_a"), big("american_b"))


@query
def stream_update_feed(spark, d):
    """The newest state and prediction update of each match, as subscribers get them."""
    rows = spark.read.parquet(f"{jobs.states(spark, d)}/updates").withColumns({
        "kind": F.get_json_object("value", "$.type"),
        "state_version": F.get_json_object("value", "$.data.state_version").cast("long"),
        "sent": F.get_json_object("value", "$.timestamp"),
    })
    last = rows.groupBy("key", "kind").agg(F.max_by("value", F.struct("state_version", "sent")).alias("value"))
    at = lambda path, kind="string": F.get_json_object("value", path).cast(kind)
    return last.select(
        F.col("key").alias("match_id"), "kind", at("$.data.state_version", "long").alias("state_version"),
        at("$.data.round_no", "int").alias("round_no"), at("$.data.phase").alias("phase"),
        at("$.data.team_a.score", "long").alias("score_a"), at("$.data.team_b.score", "long").alias("score_b"),
        at("$.data.team_a.id").alias("team_a_id"), r6(at("$.data.p_team_a_win", "double"), "p_team_a_win"),
    )


@query
def stream_timeline(spark, d):
    return jobs.timeline(spark, d).select("match_id", ms("minute", "minute_ms"), "events_count", "kills_count")


@query
def stream_round_metrics(spark, d):
    return round_out(jobs.rounds(spark, d))
