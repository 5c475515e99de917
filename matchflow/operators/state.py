"""State of a match after every event, as running aggregates.

Every field is a counter since a marker event, a last known value or a running
maximum, so the whole fold is one pass of chunked windows per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions import running as run
from matchflow.functions.scalars import parse_payload

ORDER = ["seq_no", "ts_event", "event_id"]
_FIELDS = [
    "winner_team", "victim_team", "team_a_side", "team_b_side", "team_a_econ", "team_b_econ",
    "team_a_equipment_value", "team_b_equipment_value", "team_a_id", "team_b_id", "team_a_name", "team_b_name",
    "format",
]
STATE_COLUMNS = [
    "match_id", "map_id", "format", "event_id", "type", "seq_no", "ts_event", "ts_ingest", "state_version", "round_no",
    "phase", "bomb_planted", "seconds_remaining", "team_a", "team_b",
]


def seq_chunk(rows: int = run.CHUNK_ROWS) -> Column:
    return F.floor(F.col("seq_no") / rows)


def match_state(
    raw: DataFrame, strength: DataFrame | None = None, chunk_rows: int = run.CHUNK_ROWS, before: DataFrame | None = None,
    ends_only: bool = False,
) -> DataFrame:
    """One row per event with the state after it.

    ``strength`` (team id, rating) sets team ratings; without it all teams rate
    1000. ``before`` are rows of an earlier result, one per match: the state
    that the first of the given events of the match meets. ``ends_only`` gives
    the last state of each chunk of events only, which is all a replay ends with.
    """
    kind = F.col("type")

    def is_(*names: str) -> Column:
        return kind.isin(*names)

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0).cast("long")

    def won(event: str, team: str) -> Column:
        return is_(event) & (F.coalesce(F.col("p.winner_team"), F.lit("")) == team)

    def died(team: str) -> Column:
        return is_("kill") & (F.coalesce(F.col("p.victim_team"), F.lit("")) == team)

    def sent(event: str, name: str) -> Column:
        return F.when(is_(event), F.col(f"p.{name}"))

    names = {
        f"_{t}": F.struct(
            F.coalesce(F.col(f"p.team_{t}_id"), F.lit(t.upper())).alias("id"),
            F.coalesce(F.col(f"p.team_{t}_name"), F.lit(f"Team {t.upper()}")).alias("name"),
        )
        for t in "ab"
    }
    phase = (
        F.when(is_("round_start"), "live")
        .when(is_("bomb_planted"), "bomb_planted")
        .when(is_("bomb_defused", "bomb_exploded", "round_end"), "ended")
    )
    map_start, match_start, round_start = is_("map_start"), is_("match_start"), is_("round_start")
    requests = {
        "state_version": run.row_number(),
        "first_map": run.earliest(F.col("map_id")),
        "started_map": run.latest(F.when(map_start, F.col("map_id"))),
        "round_now": run.highest_since(F.when(map_start, 1).otherwise(F.col("round_no")), map_start),
        "phase": run.latest(phase),
        "planted": run.latest(F.when(round_start, False).when(is_("bomb_planted"), True)),
        "ever_planted": run.total(one(is_("bomb_planted"))),
        "first_format": run.earliest(F.coalesce("p.format", F.lit("bo3"))),
    }
    for t, team, other in (("a", "A", "B"), ("b", "B", "A")):
        requests |= {
            f"{t}_who": run.earliest(names[f"_{t}"]),
            f"{t}_score": run.since(one(won("round_end", team)), map_start),
            f"{t}_maps": run.since(one(won("map_end", team)), match_start),
            f"{t}_dead": run.since(one(died(team)), round_start),
            f"{t}_losses": run.since(one(won("round_end", other)), won("round_end", team)),
            f"{t}_side": run.latest(sent("round_start", f"team_{t}_side")),
            f"{t}_money": run.latest(sent("economy_update", f"team_{t}_econ")),
            f"{t}_equipment": run.latest(sent("economy_update", f"team_{t}_equipment_value")),
        }
    if before is not None:
        # Whether what a value counts from lies among the given events.
        markers = {"map_start": map_start, "match_start": match_start, "round_start": round_start,
                   "a_won": won("round_end", "A"), "b_won": won("round_end", "B")}
        requests |= {f"seen_{name}": run.highest(one(marker)) for name, marker in markers.items()}
    slim = parse_payload(raw, *_FIELDS).select(
        "event_id", "match_id", "map_id", "round_no", "type", "seq_no", "ts_event", "ts_ingest", "p"
    )
    folded = run.running(slim, ["match_id"], ORDER, seq_chunk(chunk_rows), ends_only, **requests)
    if before is not None:
        folded = _continued(folded, before)
    for t in "ab":
        folded = folded.withColumn(f"{t}_id", F.col(f"{t}_who.id"))
        if strength is None:
            folded = folded.withColumn(f"{t}_rating", F.lit(1000))
        else:
            ratings = strength.select(F.col("id").cast("string").alias(f"{t}_id"), F.col("rating").alias(f"{t}_r"))
            folded = folded.join(ratings, f"{t}_id", "left").withColumn(
                f"{t}_rating", F.coalesce(f"{t}_r", F.lit(1000))
            )

    def team(t: str) -> Column:
        return F.struct(
            F.col(f"{t}_id").alias("id"),
            F.col(f"{t}_who.name").alias("name"),
            F.col(f"{t}_score").alias("score"),
            F.col(f"{t}_maps").alias("maps_won"),
            F.coalesce(f"{t}_money", F.lit(0).cast("long")).alias("money"),
            F.coalesce(f"{t}_equipment", F.lit(0).cast("long")).alias("equipment_value"),
            F.col(f"{t}_losses").alias("consecutive_round_losses"),
            F.coalesce(f"{t}_side", F.lit("CT")).alias("side"),
            F.greatest(F.lit(0), sc.PLAYERS - F.col(f"{t}_dead")).cast("long").alias("alive_count"),
            F.col(f"{t}_rating").cast("int").alias("strength_rating"),
        )

    return folded.select(
        "match_id",
        F.coalesce("started_map", "first_map").alias("map_id"),
        F.col("first_format").alias("format"),
        "event_id", "type", "seq_no", "ts_event", "ts_ingest", "state_version",
        F.col("round_now").cast("int").alias("round_no"),
        F.coalesce("phase", F.lit("warmup")).alias("phase"),
        F.coalesce("planted", F.lit(False)).alias("bomb_planted"),
        F.when(F.col("ever_planted") > 0, sc.BOMB_SECONDS).otherwise(0).alias("seconds_remaining"),
        team("a").alias("team_a"),
        team("b").alias("team_b"),
    )


def _continued(folded: DataFrame, before: DataFrame) -> DataFrame:
    """Running values over some events of a match, put on top of the state before these."""
    old = before.select("match_id", F.struct(*(c for c in STATE_COLUMNS if c != "match_id")).alias("old"))
    there = F.col("old").isNotNull()

    def kept(name: str, value: str) -> Column:
        """A last known value: the old one as long as there is no new one."""
        return F.coalesce(F.col(name), F.col(f"old.{value}")).alias(name)

    def counted(name: str, marker: str, value: str) -> Column:
        """A count since a marker: the old one goes on until the marker comes."""
        return F.when(there & (F.col(f"seen_{marker}") == 0), F.col(f"old.{value}") + F.col(name)).otherwise(F.col(name)).alias(name)

    new = {
        "state_version": F.col("state_version") + F.coalesce("old.state_version", F.lit(0)),
        "first_map": F.coalesce("old.map_id", "first_map"),
        "first_format": F.coalesce("old.format", "first_format"),
        "round_now": F.when(there & (F.col("seen_map_start") == 0), F.greatest("old.round_no", "round_now")).otherwise(
            F.col("round_now")),
        "phase": kept("phase", "phase"),
        "planted": kept("planted", "bomb_planted"),
        "ever_planted": F.col("ever_planted") + F.when(F.col("old.seconds_remaining") > 0, 1).otherwise(0),
    }
    for t, other in (("a", "b"), ("b", "a")):
        team = f"team_{t}"
        new |= {
            f"{t}_who": F.when(there, F.struct(F.col(f"old.{team}.id").alias("id"), F.col(f"old.{team}.name").alias("name")))
            .otherwise(F.col(f"{t}_who")),
            f"{t}_score": counted(f"{t}_score", "map_start", f"{team}.score"),
            f"{t}_maps": counted(f"{t}_maps", "match_start", f"{team}.maps_won"),
            # Who was out before the round counts as out, five at most.
            f"{t}_dead": F.when(
                there & (F.col("seen_round_start") == 0),
                sc.PLAYERS - F.col(f"old.{team}.alive_count") + F.col(f"{t}_dead")).otherwise(F.col(f"{t}_dead")),
            f"{t}_losses": counted(f"{t}_losses", f"{t}_won", f"{team}.consecutive_round_losses"),
            f"{t}_side": kept(f"{t}_side", f"{team}.side"),
            f"{t}_money": kept(f"{t}_money", f"{team}.money"),
            f"{t}_equipment": kept(f"{t}_equipment", f"{team}.equipment_value"),
        }
    return folded.join(old, "match_id", "left").withColumns(new).drop("old")


def final_state(state: DataFrame) -> DataFrame:
    """State after the last event of each match (what a replay ends with)."""
    rest = [c for c in state.columns if c != "match_id"]
    last = state.groupBy("match_id").agg(F.max_by(F.struct(*rest), "state_version").alias("s"))
    return last.select("match_id", "s.*")


def replay_diff(replayed: DataFrame, live: DataFrame, fields: list[str]) -> DataFrame:
    """Fields on which a replayed and a live final state disagree."""
    both = replayed.alias("r").join(live.alias("l"), F.col("r.match_id") == F.col("l.match_id"), "full_outer")
    pairs = [
        F.struct(
            F.lit(f).alias("field"),
            F.col(f"l.{f}").cast("string").alias("live"),
            F.col(f"r.{f}").cast("string").alias("replay"),
        )
        for f in fields
    ]
    return (
        both.select(F.coalesce("r.match_id", "l.match_id").alias("match_id"), F.explode(F.array(*pairs)).alias("d"))
        .select("match_id", "d.*")
        .filter(~F.col("live").eqNullSafe(F.col("replay")))
    )


def win_streaks(rounds: DataFrame, chunk_rows: int = run.CHUNK_ROWS) -> DataFrame:
    """Team on a streak of won rounds and its length, after each round of a map."""
    won_a = F.when(F.col("round_winner") == "A", 1).otherwise(0)
    won_b = F.when(F.col("round_winner") == "B", 1).otherwise(0)
    counted = run.running(
        rounds, ["match_id", "map_id"], ["round_no"], F.floor(F.col("round_no") / chunk_rows),
        _a=run.since(won_a, won_b == 1), _b=run.since(won_b, won_a == 1),
    )
    return counted.withColumns({
        "streak_team": F.when(F.col("_a") > 0, "A").when(F.col("_b") > 0, "B").otherwise("none"),
        "streak_length": F.greatest("_a", "_b").cast("long"),
    }).drop("_a", "_b")


def newer_updates(updates: DataFrame, key: str, version: str, order: list[str], chunk: Column) -> DataFrame:
    """Updates whose version exceeds every version that arrived before."""
    seen = run.running(updates, [key], order, chunk, _seen=run.highest(F.col(version), prior=True))
    return seen.filter(F.col("_seen").isNull() | (F.col(version) > F.col("_seen"))).drop("_seen")


def update_feed(rows: DataFrame, kind: str, ts: str, data: Column) -> DataFrame:
    """Envelopes ``{type, match_id, timestamp, data}`` keyed by match, ready for a sink."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.struct(F.lit(kind).alias("type"), "match_id", stamp.alias("timestamp"), data.alias("data"))
    return rows.select(F.col("match_id").alias("key"), F.to_json(body).alias("value"))
