"""How good predictions were, and reads of the stored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.functions.joins import within

from matchflow.functions import running as run
from matchflow.functions.scalars import parse_payload, text


def outcomes(raw: DataFrame) -> DataFrame:
    """Winner of each finished match, from its last ``match_end``."""
    ends = parse_payload(raw.filter(F.col("type") == "match_end"), "winner_team").filter(text("winner_team") != "")
    last = F.struct("ts_event", "seq_no")
    return ends.groupBy("match_id").agg(
        F.max_by(text("winner_team"), last).alias("winner_team"), F.max("ts_event").alias("finished_at")
    )


def judged(pred: DataFrame, outcome: DataFrame) -> DataFrame:
    """Predictions of finished matches with 1 where team A won.

    A plain equi-join: small outcomes are broadcast by their measured size,
    large ones are shuffled, and adaptive execution splits a busy match.
    """
    won = outcome.select("match_id", "finished_at", (F.col("winner_team") == "A").cast("int").alias("won_a"))
    return pred.join(won, "match_id")


def brier(pred: DataFrame, outcome: DataFrame) -> DataFrame:
    error = F.pow(F.col("p_team_a_win") - F.col("won_a"), 2)
    return judged(pred, outcome).agg(F.avg(error).alias("brier_score"), F.count("*").alias("predictions"))


def calibration(pred: DataFrame, outcome: DataFrame, bins: int = 10) -> DataFrame:
    number = F.least(F.floor(F.col("p_team_a_win") * bins), F.lit(bins - 1)).cast("int")
    return judged(pred, outcome).groupBy(number.alias("bin")).agg(
        F.avg("p_team_a_win").alias("avg_probability"),
        F.avg("won_a").alias("win_rate"),
        F.count("*").alias("predictions"),
    )


def model_quality(
    pred: DataFrame, outcome: DataFrame, as_of: Column, hours: int = 24, floor: float = 0.6
) -> DataFrame:
    """Accuracy and log loss per model version, with an alarm when the accuracy
    on matches finished in the last ``hours`` is under ``floor``."""
    p, won = F.col("p_team_a_win"), F.col("won_a")
    hit = F.when((p > 0.5) == (won == 1), 1.0).otherwise(0.0)
    loss = -F.ln(F.when(won == 1, p).otherwise(1 - p))
    recent = F.when(F.col("finished_at") > as_of - F.make_dt_interval(hours=F.lit(hours)), hit)
    return judged(pred, outcome).groupBy("model_version").agg(
        F.avg(hit).alias("accuracy"),
        F.avg(loss).alias("log_loss"),
        F.avg(F.pow(p - won, 2)).alias("brier_score"),
        F.avg(recent).alias("recent_accuracy"),
        F.count("*").alias("predictions"),
    ).withColumn("drift_alarm", F.coalesce(F.col("recent_accuracy") < floor, F.lit(False)))


def active_models(quality: DataFrame, models: DataFrame) -> DataFrame:
    """Quality rows of the registered, active models."""
    return quality.join(models.filter("is_active").select("model_version", "model_name"), "model_version")


def _moment(ts: str, number: str) -> Column:
    """A time and a number (below 10^18) in one decimal that sorts like both; hash aggregates can hold it."""
    return F.unix_micros(ts).cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(number).cast("decimal(19,0)")


def latest_prediction(pred: DataFrame) -> DataFrame:
    """The newest prediction of each match.

    Only the moment of the newest one is aggregated, by hash; its row is then
    looked up. The points of a match are neither sorted nor moved.
    """
    rows = pred.drop("components").withColumn("__at", _moment("ts_calc", "state_version"))
    newest = rows.groupBy("match_id").agg(F.max("__at").alias("__at"))
    rest = [c for c in rows.columns if c not in ("match_id", "__at")]
    found = rows.join(newest, ["match_id", "__at"], "left_semi")
    # More than one row only where a point was stored twice.
    return found.groupBy("match_id", "__at").agg(F.max(F.struct(*rest)).alias("p")).select("match_id", "p.*")


def latest_n(df: DataFrame, keys: list[str], order: list[str], n: int, cap: int = 100) -> DataFrame:
    """Newest ``n`` (at most ``cap``) rows per key, numbered. Tasks drop what cannot qualify
    before the shuffle, so a busy key sends ``n`` rows per task."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= within(n, cap))


def prediction_history(pred: DataFrame, first_round: int | None = None, last_round: int | None = None) -> DataFrame:
    """Points of the probability curve, ordered, optionally of a round range."""
    rows = pred
    if first_round is not None:
        rows = rows.filter(F.col("round_no") >= first_round)
    if last_round is not None:
        rows = rows.filter(F.col("round_no") <= last_round)
    return rows.select(
        "match_id", "map_id", "ts_calc", "state_version", "round_no", "p_team_a_win", "p_team_b_win", "confidence",
        "trigger_event_type",
    )


def prediction_curve(pred: DataFrame, match_id: Column | None = None) -> DataFrame:
    """The probability curve of one match or of all, each point with its ``place`` from the oldest on.

    Of one match only its rows are read (the table is sorted by match). Places
    are counted by minutes, so a match with very many points is spread.
    """
    rows = prediction_history(pred if match_id is None else pred.filter(F.col("match_id") == match_id))
    minute = F.floor(F.unix_millis("ts_calc") / 60_000)
    return run.running(rows, ["match_id"], ["ts_calc", "map_id", "state_version"], minute, place=run.row_number())


def events_between(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events of a time range. Of a table kept by month only the months of the range are read."""
    if "month" in raw.columns:
        months = [F.date_format(x, "yyyyMM").cast("int") for x in (start, end)]
        raw = raw.filter(F.col("month").between(*months))
    return raw.filter(F.col("ts_event").between(start, end))


def prediction_history_doc(pred: DataFrame, page: int = 500) -> DataFrame:
    """History documents: team ids and an ordered array of points.

    A document comes in pages of ``page`` points, so no array grows with a
    match; all points are kept.
    """
    keys = ["match_id", "map_id"]
    order = ["state_version"]
    chunk = F.floor(F.col("state_version") / run.CHUNK_ROWS)
    numbered = run.running(
        pred, keys, order, chunk, _n=run.row_number(), _points=run.whole(F.lit(1).cast("long")),
        _teams=run.earliest(F.struct("team_a_id", "team_b_id")),
    )
    point = F.struct(
        "state_version", "ts_calc", "round_no", "p_team_a_win", "p_team_b_win", "confidence", "trigger_event_type"
    )
    return (
        numbered.withColumn("page", F.floor((F.col("_n") - 1) / page))
        .groupBy(*keys, "page")
        .agg(
            F.first("_teams").alias("t"), F.first("_points").alias("total_points"),
            F.sort_array(F.collect_list(point)).alias("points"),
        )
        .select(*keys, "page", "t.team_a_id", "t.team_b_id", "total_points", "points")
    )


def match_latest_prediction(matches: DataFrame, pred: DataFrame) -> DataFrame:
    """Every match with its latest prediction, if any."""
    shown = ["match_id", "ts_calc", "round_no", "p_team_a_win", "p_team_b_win", "confidence"]
    # Only what is shown takes part in the look-up, whose rows may have to be shuffled.
    last = latest_prediction(pred.select(*shown, "state_version")).select(*shown)
    return matches.join(last, "match_id", "left")
