"""Per round, match, player, team and minute metrics from stored events.

Inputs hold each event once (see ``dedup``). Every rollup parses the payload
once and shuffles partial aggregates, not events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions import running as run
from matchflow.functions.joins import join_null_safe
from matchflow.functions.scalars import clamp, count_if, flag, number, parse_payload, seconds_between, text

ROUND = ["match_id", "map_id", "round_no"]


def _at(when: Column) -> Column:
    return F.when(when, F.struct("ts_event", "seq_no"))


def _is(*names: str) -> Column:
    return F.col("type").isin(*names)


def _kill(team: str) -> Column:
    return _is("kill") & (text("killer_team") == team)


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, _at(when))


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, _at(when))


def events_parsed(raw: DataFrame) -> DataFrame:
    """Typed columns of kills, economy updates and round ends."""
    texts = ["killer_team", "victim_team", "weapon", "winner_team", "win_reason"]
    numbers = ["team_a_econ", "team_b_econ", "team_a_equipment_value", "team_b_equipment_value"]
    rows = parse_payload(raw.filter(_is(*sc.PARSED_TYPES)), *texts, *numbers, "is_headshot")
    return rows.select(
        F.to_date("ts_event").alias("date"), "ts_event", "match_id", "map_id", "round_no", "event_id", "type",
        *(text(c).alias(c) for c in texts), flag("is_headshot").alias("is_headshot"),
        *(number(c).alias(c) for c in numbers),
    )


def _round_aggregates() -> list[Column]:
    ended = _is("round_end")
    out = []
    for t, team in (("a", "A"), ("b", "B")):
        out += [
            count_if(_kill(team)).alias(f"team_{t}_kills"),
            count_if(_kill(team) & flag("is_headshot")).alias(f"team_{t}_headshots"),
            count_if(_kill(team) & flag("is_first_kill")).alias(f"team_{t}_first_kills"),
            F.coalesce(F.max(F.when(ended, number(f"team_{t}_score"))), F.lit(0).cast("long")).alias(f"team_{t}_score"),
        ]
    return out + [
        F.count("*").alias("events_count"),
        F.min("ts_event").alias("first_event_ts"),
        F.max("ts_event").alias("last_event_ts"),
    ]


_ROUND_FIELDS = ["killer_team", "is_headshot", "is_first_kill", "winner_team", "team_a_score", "team_b_score"]


def _rounds(rows: DataFrame, keys: list[str], sums: list[Column], picks: list[Column], kinds: list[str]) -> DataFrame:
    """Sums over all events, and picks by time over the events of ``kinds`` only.

    Sums are numbers and times: their aggregate hashes. Picks carry text or
    structs and make an aggregate sort its input, which is then the few events
    of these types; only the rounds are joined.
    """
    told = rows.filter(_is(*kinds)).groupBy(*keys).agg(*picks)
    return join_null_safe(rows.groupBy(*keys).agg(*sums), told, keys)


def _finish_rounds(rounds: DataFrame) -> DataFrame:
    return rounds.withColumns({
        "date": F.to_date("first_event_ts"),
        "version": F.unix_millis("last_event_ts"),
        "round_duration_sec": seconds_between(F.col("first_event_ts"), F.col("last_event_ts")),
    })


def round_metrics(
    raw: DataFrame, *more: Column, picks: list[Column] | None = None, kinds: list[str] | None = None,
    fields: list[str] | None = None,
) -> DataFrame:
    """Kills, scores, winner and times of every round.

    ``more`` adds aggregates over all events, ``picks`` such that read events
    of the types ``kinds`` only; ``fields`` names payload fields they need.
    """
    rows = parse_payload(raw, *_ROUND_FIELDS, *(f for f in fields or [] if f not in _ROUND_FIELDS))
    winner = _last(text("winner_team"), _is("round_end")).alias("round_winner")
    rounds = _rounds(
        rows, ROUND, [*_round_aggregates(), *more], [winner, *(picks or [])], ["round_end", *(kinds or [])])
    return _finish_rounds(rounds.withColumn("round_winner", F.coalesce("round_winner", F.lit(""))))


# How stored partial aggregates of rounds merge.
ROUND_SUMS = [f"team_{t}_{m}" for t in "ab" for m in ("kills", "headshots", "first_kills")] + ["events_count"]
ROUND_MINS = ["first_event_ts"]
ROUND_MAXS = ["team_a_score", "team_b_score", "last_event_ts", "last_win"]


def round_partials(raw: DataFrame, batch: Column) -> DataFrame:
    """Round aggregates of each batch of events, in a form that can be merged."""
    rows = parse_payload(raw, *_ROUND_FIELDS).withColumn("batch", batch)
    win = F.max(F.when(_is("round_end"), F.struct("ts_event", "seq_no", text("winner_team").alias("winner"))))
    return _rounds(rows, ["batch", *ROUND], _round_aggregates(), [win.alias("last_win")], ["round_end"])


def merge_partials(
    partials: DataFrame, keys: list[str], sum_cols: list[str], min_cols: list[str], max_cols: list[str]
) -> DataFrame:
    return partials.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sum_cols),
        *(F.min(c).alias(c) for c in min_cols),
        *(F.max(c).alias(c) for c in max_cols),
    )


def merged_rounds(partials: DataFrame) -> DataFrame:
    """Round metrics from stored partials; equals ``round_metrics``."""
    merged = merge_partials(partials, ROUND, ROUND_SUMS, ROUND_MINS, ROUND_MAXS)
    named = merged.withColumn("round_winner", F.coalesce("last_win.winner", F.lit(""))).drop("last_win")
    return _finish_rounds(named)


def match_metrics(raw: DataFrame) -> DataFrame:
    """Totals and status of every map of a match."""
    rows = parse_payload(raw, "killer_team", "is_headshot", "team_a_score", "team_b_score")
    ended = _is("round_end")
    zero = F.lit(0).cast("long")
    return (
        rows.groupBy("match_id", "map_id")
        .agg(
            F.max("round_no").alias("total_rounds"),
            F.coalesce(F.max(F.when(ended, number("team_a_score"))), zero).alias("team_a_rounds_won"),
            F.coalesce(F.max(F.when(ended, number("team_b_score"))), zero).alias("team_b_rounds_won"),
            count_if(_is("kill")).alias("total_kills"),
            count_if(_kill("A")).alias("team_a_kills"),
            count_if(_kill("B")).alias("team_b_kills"),
            count_if(_is("kill") & flag("is_headshot")).alias("total_headshots"),
            F.count("*").alias("events_count"),
            F.min("ts_event").alias("match_start_ts"),
            F.max("ts_event").alias("last_event_ts"),
            F.when(F.count_if(_is("match_end")) > 0, "finished")
            .when(F.count_if(_is("match_start")) > 0, "live")
            .otherwise("unknown").alias("status"),
        )
        .withColumn("date", F.to_date("match_start_ts"))
    )


def live_matches_recent(metrics: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Live maps with an event in the last minutes and the seconds since."""
    recent = F.col("last_event_ts") > as_of - F.make_dt_interval(mins=F.lit(minutes))
    return metrics.filter((F.col("status") == "live") & recent).select(
        "match_id", "map_id", "team_a_rounds_won", "team_b_rounds_won", "total_kills", "events_count",
        "match_start_ts", "last_event_ts",
        seconds_between(F.col("last_event_ts"), as_of).alias("seconds_since_last_event"),
    )


def player_stats(raw: DataFrame, by_round: bool = False) -> DataFrame:
    """Kills, deaths, headshots, first kills and damage per player and team.

    A kill counts for two players. Both sides come from one scan and one
    shuffle: the event is split into its entries before the aggregate.
    """
    rows = parse_payload(
        raw.filter(_is("kill", "player_hurt")),
        "killer_player_id", "killer_team", "victim_player_id", "victim_team", "is_headshot", "is_first_kill",
        "attacker_player_id", "attacker_team", "damage",
    )

    def entry(player: str, team: str, kills=0, deaths=0, headshots=0, first=0, damage=0) -> Column:
        values = {"kills": kills, "deaths": deaths, "headshots": headshots, "first_kills": first, "damage_dealt": damage}
        return F.struct(
            text(player).alias("player_id"), text(team).alias("team"),
            *((v if isinstance(v, Column) else F.lit(v)).cast("long").alias(n) for n, v in values.items()),
        )

    entries = F.when(_is("kill"), F.array(
        entry("killer_player_id", "killer_team", kills=1, headshots=flag("is_headshot").cast("int"),
              first=flag("is_first_kill").cast("int")),
        entry("victim_player_id", "victim_team", deaths=1),
    )).otherwise(F.array(entry("attacker_player_id", "attacker_team", damage=number("damage"))))
    keys = ROUND if by_round else ROUND[:2]
    split = rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    names = ["kills", "deaths", "headshots", "first_kills", "damage_dealt"]
    return split.groupBy(*keys, "player_id", "team").agg(*(F.sum(n).alias(n) for n in names))


def player_leaderboard(stats: DataFrame, players: DataFrame) -> DataFrame:
    """Player statistics with nickname and team of the player, where known."""
    names = players.select(F.col("id").alias("player_id"), "nickname", F.col("team").alias("home_team"))
    return stats.join(names, "player_id", "left")


def team_round_stats(raw: DataFrame) -> DataFrame:
    """Highest equipment value and money of each team per round."""
    rows = parse_payload(
        raw.filter(_is("economy_update")), "team_a_econ", "team_b_econ", "team_a_equipment_value",
        "team_b_equipment_value",
    )
    sides = F.array(*(
        F.struct(
            F.lit(team).alias("team"), number(f"team_{t}_equipment_value").alias("equipment_value"),
            number(f"team_{t}_econ").alias("money_start"),
        )
        for t, team in (("a", "A"), ("b", "B"))
    ))
    split = rows.select(*ROUND, F.explode(sides).alias("e")).select(*ROUND, "e.*")
    return split.groupBy(*ROUND, "team").agg(
        F.max("equipment_value").alias("equipment_value"), F.max("money_start").alias("money_start")
    )


def match_timeline(raw: DataFrame, bucket: str = "minute") -> DataFrame:
    return raw.groupBy("match_id", F.date_trunc(bucket, "ts_event").alias("minute")).agg(
        F.count("*").alias("events_count"), count_if(_is("kill")).alias("kills_count")
    )


def event_counts(raw: DataFrame, by_map: bool = False) -> DataFrame:
    keys = ["match_id", "map_id"] if by_map else ["match_id"]
    return raw.groupBy(*keys, "type").agg(F.count("*").alias("events"))


def weapon_stats(raw: DataFrame) -> DataFrame:
    rows = parse_payload(raw.filter(_is("kill")), "weapon", "is_headshot")
    return rows.groupBy(text("weapon").alias("weapon")).agg(
        F.count("*").alias("kills"), count_if(flag("is_headshot")).alias("headshots")
    )


def round_view(rounds: DataFrame) -> DataFrame:
    return rounds.select(
        *ROUND, "team_a_kills", "team_b_kills", "team_a_headshots", "team_b_headshots", "team_a_score", "team_b_score",
        "round_winner", "round_duration_sec",
    )


def match_summary(raw: DataFrame) -> DataFrame:
    """Rounds won, kills, headshot shares, mean round length and status per map."""
    rounds = round_metrics(
        raw,
        count_if(_is("match_start")).alias("starts"),
        count_if(_is("match_end")).alias("ends"),
    )
    out = []
    for t, team in (("a", "A"), ("b", "B")):
        kills, headshots = F.sum(f"team_{t}_kills"), F.sum(f"team_{t}_headshots")
        out += [
            count_if(F.col("round_winner") == team).alias(f"team_{t}_rounds"),
            kills.alias(f"team_{t}_total_kills"),
            F.coalesce(F.try_divide(headshots, kills) * 100, F.lit(0.0)).alias(f"team_{t}_hs_percentage"),
        ]
    return rounds.groupBy("match_id", "map_id").agg(
        *out,
        F.avg("round_duration_sec").alias("avg_round_duration_sec"),
        F.when(F.sum("ends") > 0, "finished").when(F.sum("starts") > 0, "live").otherwise("unknown").alias("status"),
    )


def half_of_map(round_no: Column) -> Column:
    return (
        F.when(round_no <= sc.HALF_ROUNDS, "1").when(round_no <= sc.REGULATION_ROUNDS, "2").otherwise("overtime")
    )


def round_enriched(raw: DataFrame, last_rounds: int = 5) -> DataFrame:
    """Round metrics with economy, first blood, momentum, pressure and half.

    Momentum is (rounds won by A - by B) / ``last_rounds`` over the latest
    round numbers. It looks back a fixed number of rounds, so rounds are
    spread by round number and not gathered per match.
    """
    economy = _is("economy_update")
    rounds = round_metrics(
        raw,
        picks=[
            _last(number("team_a_econ"), economy).alias("team_a_econ"),
            _last(number("team_b_econ"), economy).alias("team_b_econ"),
            _first(text("killer_team"), _is("kill")).alias("first_blood_team"),
        ],
        kinds=["economy_update", "kill"], fields=["team_a_econ", "team_b_econ"],
    )
    balance = F.when(F.col("round_winner") == "A", 1).when(F.col("round_winner") == "B", -1).otherwise(0)
    moved = run.sliding(rounds, ["match_id", "map_id"], "round_no", last_rounds, _balance=balance)
    zero = F.lit(0).cast("long")
    return moved.withColumns({
        "team_a_econ": F.coalesce("team_a_econ", zero),
        "team_b_econ": F.coalesce("team_b_econ", zero),
        "first_blood_team": F.coalesce("first_blood_team", F.lit("")),
        "momentum": F.col("_balance") / last_rounds,
        "current_half": half_of_map(F.col("round_no")),
    }).withColumn(
        "economy_pressure", clamp((F.col("team_a_econ") - F.col("team_b_econ")) / 10_000, -1.0, 1.0)
    ).drop("_balance")


def round_report(raw: DataFrame) -> DataFrame:
    """Winner, reason, players alive, first blood and length of every round."""
    ended, kill = _is("round_end"), _is("kill")
    end = F.struct("p.win_reason", "p.team_a_alive", "p.team_b_alive")
    blood = F.struct("p.killer_player_id", "p.killer_team")
    rounds = round_metrics(
        raw, picks=[_last(end, ended).alias("end"), _first(blood, kill).alias("blood")], kinds=["kill"],
        fields=["win_reason", "team_a_alive", "team_b_alive", "killer_player_id"],
    )
    return rounds.select(
        *ROUND, F.col("round_winner").alias("winner_team"), "end.win_reason",
        "team_a_kills", "team_b_kills", "end.team_a_alive", "end.team_b_alive",
        F.col("blood.killer_player_id").alias("first_blood_player"),
        F.col("blood.killer_team").alias("first_blood_team"),
        "round_duration_sec",
    )


def team_match_stats(raw: DataFrame) -> DataFrame:
    """Per match and team: rounds, kills, deaths, shares, economy and damage.

    Every event is split into the entries of the teams it concerns.
    """
    rows = parse_payload(
        raw.filter(_is("kill", "round_end", "economy_update", "player_hurt")),
        "killer_team", "victim_team", "is_headshot", "is_first_kill", "winner_team", "team_a_econ", "team_b_econ",
        "attacker_team", "damage",
    )
    names = ["rounds", "rounds_won", "kills", "deaths", "headshots", "first_kills", "econ", "econ_n", "damage"]

    def entry(team: Column, **values: Column | int) -> Column:
        return F.struct(team.alias("team"), *(
            (v if isinstance(v, Column) else F.lit(v)).cast("long").alias(n)
            for n, v in ((n, values.get(n, 0)) for n in names)
        ))

    def as_int(c: Column) -> Column:
        return c.cast("int")

    both = [F.lit(t) for t in sc.TEAMS]
    entries = (
        F.when(_is("kill"), F.array(
            entry(text("killer_team"), kills=1, headshots=as_int(flag("is_headshot")),
                  first_kills=as_int(flag("is_first_kill"))),
            entry(text("victim_team"), deaths=1),
        ))
        .when(_is("round_end"), F.array(*(
            entry(t, rounds=1, rounds_won=as_int(text("winner_team") == t)) for t in both
        )))
        .when(_is("economy_update"), F.array(
            entry(both[0], econ=number("team_a_econ"), econ_n=1), entry(both[1], econ=number("team_b_econ"), econ_n=1)
        ))
        .otherwise(F.array(entry(text("attacker_team"), damage=number("damage"))))
    )
    sums = (
        rows.select("match_id", F.explode(entries).alias("e")).select("match_id", "e.*")
        .groupBy("match_id", "team").agg(*(F.sum(n).alias(n) for n in names))
    )

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)).cast("double"), F.lit(0.0))

    return sums.select(
        "match_id", "team", "rounds_won", "kills", "deaths",
        (ratio("headshots", "kills") * 100).alias("headshot_percentage"),
        ratio("first_kills", "rounds").alias("first_kill_rate"),
        ratio("econ", "econ_n").alias("avg_economy"),
        ratio("damage", "rounds").alias("damage_per_round"),
    )
