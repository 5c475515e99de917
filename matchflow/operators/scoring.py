"""Features, the rule model, the swing limiter and published predictions."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions import running as run
from matchflow.functions import scan as sn
from matchflow.functions.scalars import american_odds, clamp, decimal_odds, safe_probability
from matchflow.session import cut

# Fixed values of the rule model and of the swing limiter.
MODEL_VERSION = "v0.1.0-baseline"
WEIGHTS = {"strength": 0.1, "alive": 0.15, "equipment": 0.05, "bomb": 0.25, "streak": 0.02}
LOW, HIGH = 0.05, 0.95
SWING_PER_SECOND, SWING_BASE = 0.20, 0.05
MOVE_BASE, MOVE_PER_SECOND = 0.20, 0.05
LEAST, MOST = 0.01, 0.99


def significant(events: DataFrame) -> DataFrame:
    """Events that trigger a new prediction."""
    return events.filter(F.col("type").isin(*sc.SIGNIFICANT_TYPES))


def features(state: DataFrame) -> DataFrame:
    def diff(name: str) -> Column:
        return F.col(f"team_a.{name}") - F.col(f"team_b.{name}")

    return state.withColumns({
        "econ_diff": clamp(diff("money") / 10_000, -1.0, 1.0),
        "equip_diff": clamp(diff("equipment_value") / 10_000, -1.0, 1.0),
        "alive_diff": diff("alive_count"),
        "win_streak_a": F.col("team_b.consecutive_round_losses"),
        "win_streak_b": F.col("team_a.consecutive_round_losses"),
        "strength_diff": diff("strength_rating") / 500,
    })


def score(features: DataFrame, model_version: str = MODEL_VERSION) -> DataFrame:
    """Rule model: win probability of team A, of team B, and confidence."""
    w = WEIGHTS
    bomb = (
        F.when(~F.col("bomb_planted"), 0.0)
        .when(F.col("team_a.side") == "T", w["bomb"])
        .otherwise(-w["bomb"])
    )
    p = (
        F.lit(0.5)
        + F.col("strength_diff") * w["strength"]
        + F.col("alive_diff") * w["alive"]
        + F.col("equip_diff") * w["equipment"]
        + bomb
        + (F.col("win_streak_a") - F.col("win_streak_b")) * w["streak"]
    )
    alive = F.col("team_a.alive_count") + F.col("team_b.alive_count")
    sure = 1 - alive / 10 + F.when(F.col("bomb_planted"), 0.2).otherwise(0.0)
    return features.withColumns({
        "p_raw": safe_probability(clamp(p, LOW, HIGH)),
        "confidence": clamp(sure, 0.1, 0.95),
        "model_version": F.lit(model_version),
    })


def _chunk(rows: int) -> Column:
    return F.floor(F.col("state_version") / rows)


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_millis(end) - F.unix_millis(start)) / 1000.0


def swing_flags(scored: DataFrame, chunk_rows: int = run.CHUNK_ROWS, p: str = "p_raw") -> DataFrame:
    """Move since the prediction before and whether it is anomalous."""
    before = run.running(
        scored, ["match_id"], ["state_version"], _chunk(chunk_rows),
        _last=run.previous(F.struct(F.col(p).alias("p"), F.col("ts_event").alias("ts"))),
    )
    dt = _seconds(F.col("_last.ts"), F.col("ts_event"))
    move = F.col(p) - F.col("_last.p")
    out = before.withColumns({"dt_seconds": dt, "p_move": move}).drop("_last")
    jump = (F.col("dt_seconds") > 0) & (
        F.abs("p_move") > F.col("dt_seconds") * SWING_PER_SECOND + SWING_BASE
    )
    return out.withColumn("is_jump", F.coalesce(jump, F.lit(False)))


def _limits(ms: list[int]) -> tuple[list[float], list[float]]:
    """Per row after the first: how far the value may move freely, and by how much it is moved otherwise.

    Rows at the same time or earlier than the one before are free.
    """
    dt = np.diff(np.array(ms, "i8")) / 1000
    allowed = dt * MOVE_PER_SECOND + MOVE_BASE
    free = np.where(dt <= 0, np.inf, np.maximum(dt * SWING_PER_SECOND + SWING_BASE, allowed))
    return free.tolist(), allowed.tolist()


def _moved(x: float, p: float, free: float, allowed: float) -> float:
    """The value published after ``x`` where the model says ``p``."""
    gap = p - x
    if abs(gap) <= free:
        return p
    return min(MOST, max(LEAST, x + (allowed if gap > 0 else -allowed)))


def _published(x: float, ps: list[float], free: list[float], allowed: list[float]) -> list[float]:
    """Values from ``x`` on, which is the one of the first row."""
    out = [x]
    for p, f, a in zip(ps[1:], free, allowed):
        x = _moved(x, p, f, a)
        out.append(x)
    return out


#: Pieces of a map: from which value on, whether the value counts, what is added.
_Map = list[tuple[float, bool, float]]
_SAME: _Map = [(0.0, True, 0.0)]


def _then(pieces: _Map, p: float, free: float, allowed: float) -> _Map:
    """A map of values followed by one more row.

    A row maps values far below ``p`` up by a step, values far above down by
    one, and the rest to ``p``. All maps rise nowhere faster than the value, and
    what falls on ``p`` stays together, so pieces remain few.
    """
    if free == math.inf:
        return [(0.0, False, p)]
    cuts = sorted({p - free, math.nextafter(p + free, math.inf), MOST - allowed, LEAST + allowed})
    out: _Map = []
    for (start, moving, add), (end, _, _) in zip(pieces, [*pieces[1:], (math.inf, False, 0.0)]):
        inner = [c - add for c in cuts if start < c - add < end] if moving else []
        for at in [start, *inner]:
            if not moving:
                new = (at, False, _moved(add, p, free, allowed))
            else:
                value = at + add
                if any(abs(value - c) < 1e-12 for c in cuts):
                    value += 1e-12  # a piece is told by its inside
                after = _moved(value, p, free, allowed)
                steady = after == p or after in (LEAST, MOST)
                new = (at, False, after) if steady else (at, True, add + (allowed if p > value else -allowed))
            if not (out and out[-1][1:] == new[1:]):
                out.append(new)
    return out


def _value(pieces: _Map, x: float) -> float:
    _, moving, add = max((q for q in pieces if q[0] <= x), default=pieces[0])
    return x + add if moving else add


def _swing_summary(rows: pa.Table, _: bytes | None) -> bytes:
    """The map from the value of a chunk's first row to that of its last.

    Maps do not fall, so where the lowest and the highest value end alike, all do.
    """
    ms, ps = rows.column("ms").to_pylist(), rows.column("p").to_pylist()
    free, allowed = _limits(ms)
    low, high = 0.0, 1.0
    for p, f, a in zip(ps[1:], free, allowed):
        low = _moved(low, p, f, a)
        high = low if low == high else _moved(high, p, f, a)
    pieces = [(0.0, False, low)]
    if low != high:
        pieces = _SAME
        for p, f, a in zip(ps[1:], free, allowed):
            pieces = _then(pieces, p, f, a)
    return pickle.dumps((ms[0], ps[0], ms[-1], pieces))


def _swing_step(before: bytes | None, summary: bytes, _: bytes | None) -> tuple[bytes, bytes]:
    first_ms, p, last_ms, pieces = pickle.loads(summary)
    x = p
    if before:
        ms, x = pickle.loads(before)
        free, allowed = _limits([ms, first_ms])
        x = _moved(x, p, free[0], allowed[0])
    return pickle.dumps(x), pickle.dumps((last_ms, _value(pieces, x)))


def _swing_rows(rows: pa.Table, carry: bytes | None) -> pa.Table:
    ms, ps = rows.column("ms").to_pylist(), rows.column("p").to_pylist()
    values = _published(pickle.loads(carry) if carry else ps[0], ps, *_limits(ms))
    return pa.table({"state_version": rows.column("state_version"), "p_team_a_win": pa.array(values, pa.float64())})


def limit_swing(scored: DataFrame, chunk_rows: int = run.CHUNK_ROWS, before: DataFrame | None = None) -> DataFrame:
    """Limit each probability against the one published before it.

    The published value depends on the published value before. A row is a map
    from the one to the other, made of few pieces, and so is a chunk of rows.
    The maps of all chunks are found side by side and folded, one row per chunk;
    then all chunks are worked through from the values they start with. The work
    is linear in the rows, however long a match is limited without pause.

    ``before`` (match_id, ms, p) has the last value published before the given
    rows of a match, and when. Most matches are one chunk, whose first row is
    published as it is; only matches of several chunks are summed up.
    """
    points = scored.select(
        "match_id", F.col("state_version").cast("long").alias("state_version"),
        F.unix_millis("ts_event").alias("ms"), F.col("p_raw").cast("double").alias("p"),
    )
    if before is not None:
        # A row of its own in front of all others; the last join leaves it out.
        points = points.unionByName(before.select("match_id", F.lit(-1).cast("long").alias("state_version"), "ms", "p"))
    slim = sn.chunked(points, _chunk(chunk_rows))
    keys, order = ["match_id"], ["state_version"]
    several = slim
    if before is None:
        # Versions count from 1, so all else is one chunk; at most one match in ``chunk_rows`` rows is found here.
        long = slim.filter(~F.col("state_version").between(0, chunk_rows - 1)).select(*keys).distinct()
        several = slim.join(F.broadcast(long), keys, "left_semi")
    carries = sn.carried(sn.summed_up(several, keys, order, _swing_summary), keys, _swing_step)
    published = sn.per_chunk(slim, keys, order, _swing_rows, "state_version bigint, p_team_a_win double", carries)
    return scored.join(published.drop(sn.CHUNK), ["match_id", "state_version"]).select(*scored.columns, "p_team_a_win")


def with_odds(limited: DataFrame, margin: float = 0.06) -> DataFrame:
    """The published prediction: both probabilities, odds and the parts behind them."""
    both = limited.withColumns({
        "p_team_b_win": 1 - F.col("p_team_a_win"),
        "odds_a": decimal_odds(F.col("p_team_a_win"), margin),
        "odds_b": decimal_odds(1 - F.col("p_team_a_win"), margin),
    })
    parts = F.create_map(
        F.lit("alive_diff"), F.col("alive_diff").cast("double"),
        F.lit("equip_diff"), F.col("equip_diff"),
        F.lit("bomb"), F.when(F.col("bomb_planted"), 1.0).otherwise(0.0),
        F.lit("odds_a"), F.col("odds_a"),
        F.lit("odds_b"), F.col("odds_b"),
    )
    return both.select(
        "match_id", "map_id", "round_no", F.col("ts_event").alias("ts_calc"), "state_version", "seq_no",
        "model_version", F.col("team_a.id").alias("team_a_id"), F.col("team_b.id").alias("team_b_id"),
        "p_raw", "p_team_a_win", "p_team_b_win", "confidence",
        (F.col("p_team_a_win") != F.col("p_raw")).alias("limited"),
        F.col("event_id").alias("trigger_event_id"), F.col("type").alias("trigger_event_type"),
        "odds_a", "odds_b",
        american_odds(F.col("odds_a")).alias("american_a"), american_odds(F.col("odds_b")).alias("american_b"),
        parts.alias("components"), F.to_json(parts).alias("features"),
    )


def predictions(
    state: DataFrame, model_version: str = MODEL_VERSION, margin: float = 0.06, before: DataFrame | None = None
) -> DataFrame:
    """State rows to published predictions, on significant events only; ``before`` as in ``limit_swing``."""
    # The limiter goes over its input several times: let it read, not recompute.
    scored = cut(score(features(significant(state)), model_version))
    return with_odds(limit_swing(scored, before=before), margin)
