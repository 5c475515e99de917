"""Matches, teams and maps: lists, documents, pages and team form."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions.joins import within
from matchflow.functions.scalars import cursor


def _team(teams: DataFrame, side: str) -> DataFrame:
    return teams.select(F.col("id").alias(f"team_{side}_id"), F.col("name").alias(f"team_{side}_name"))


def with_teams(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Both team names. No broadcast is forced: Spark takes one when the team
    table is measured to be small and else shuffles, splitting busy teams."""
    return matches.join(_team(teams, "a"), "team_a_id").join(_team(teams, "b"), "team_b_id")


def live_matches(matches: DataFrame, teams: DataFrame) -> DataFrame:
    return with_teams(matches.filter(F.col("status") == "live"), teams)


def match_details(matches: DataFrame, teams: DataFrame, maps: DataFrame) -> DataFrame:
    """Matches with teams and the map being played, if any."""
    current = maps.filter(F.col("status") == "live").select(
        F.col("match_id").alias("id"), "map_number", "map_name", "team_a_score", "team_b_score"
    )
    return with_teams(matches, teams).join(current, "id", "left")


def match_document(matches: DataFrame, teams: DataFrame, maps: DataFrame, page: int = 50) -> DataFrame:
    """Match with teams, winner and ordered maps.

    Maps come in pages of ``page`` map numbers; a match of usual length has
    one page. A match without maps has one page with an empty array. Maps may
    have a ``winner_id``; then each carries the name of its winner.
    """
    entry = F.struct("map_number", "map_name", "team_a_score", "team_b_score", "status", "map_winner")
    won = teams.select(F.col("id").alias("winner_id"), F.col("name").alias("map_winner"))
    named = maps.join(won, "winner_id", "left") if "winner_id" in maps.columns else maps.withColumn(
        "map_winner", F.lit(None).cast("string"))
    pages = (
        named.withColumn("page", F.floor((F.col("map_number") - 1) / page))
        .groupBy(F.col("match_id").alias("id"), "page")
        .agg(F.sort_array(F.collect_list(entry)).alias("maps"))
    )
    winner = teams.select(F.col("id").alias("winner_id"), F.col("name").alias("winner_name"))
    full = with_teams(matches, teams).join(winner, "winner_id", "left").join(pages, "id", "left")
    return full.withColumns({
        "page": F.coalesce("page", F.lit(0).cast("long")),
        "maps": F.coalesce("maps", F.array().cast(pages.schema["maps"].dataType)),
    })


def match_search(
    matches: DataFrame,
    status: str | None = None,
    team: int | None = None,
    tournament: str | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    rows = matches
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if team is not None:
        rows = rows.filter((F.col("team_a_id") == team) | (F.col("team_b_id") == team))
    if tournament is not None:
        rows = rows.filter(F.col("tournament") == tournament)
    if start_ms is not None:
        rows = rows.filter(F.col("scheduled_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.filter(F.col("scheduled_ms") <= end_ms)
    return rows


def status_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count("*").alias("matches"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order (top-k, no full sort); at most ``sc.MAX_PAGE``."""
    return df.orderBy(*order).offset(offset).limit(within(limit, sc.MAX_PAGE))


def placed(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of each key in order, numbered from 1; for keys with a bounded number of rows."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def live_page(matches: DataFrame, teams: DataFrame, limit: int = 50) -> DataFrame:
    """Live matches with their teams, latest start first."""
    order = [F.col("started_ms").desc(), F.col("id")]
    return placed(page(live_matches(matches, teams), order, limit), [], order)


def page_after(matches: DataFrame, after: str | None, limit: int = 20) -> DataFrame:
    """The page of matches that follows a cursor; the first one without a cursor."""
    offset = 0
    if after is not None:
        text = base64.b64decode(after, validate=True).decode()
        if not text.isdigit():
            raise ValueError(f"no cursor: {after}")
        offset = int(text)
    return match_page(matches, limit, offset)


def match_page(matches: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of matches, latest start first, with cursors and the total.

    Only the rows of the page are numbered.
    """
    start = F.coalesce("started_ms", "scheduled_ms")
    order = [start.desc(), F.col("id")]
    rows = page(matches, order, limit, offset)
    total = matches.agg(F.count("*").alias("n")).scalar()
    numbered = rows.withColumn(
        "place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long") + offset
    )
    return numbered.withColumns({"cursor": cursor(F.col("place")), "total": total}).withColumn(
        "has_next_page", F.col("total") > offset + limit
    )


def teams_by_rating(teams: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return page(teams, [F.col("rating").desc(), F.col("id")], limit, offset)


def recent_matches(matches: DataFrame, n: int = 10, most: int = 50) -> DataFrame:
    """The last ``n`` (at most ``most``) finished matches of every team, from its point of view."""
    finished = matches.filter(F.col("status") == "finished")
    sides = F.array(
        F.struct(F.col("team_a_id").alias("team_id"), F.col("team_b_id").alias("opponent_id")),
        F.struct(F.col("team_b_id").alias("team_id"), F.col("team_a_id").alias("opponent_id")),
    )
    seen = finished.select("id", "finished_ms", "winner_id", F.explode(sides).alias("s")).select(
        "id", "finished_ms", "winner_id", "s.*"
    )
    newest = Window.partitionBy("team_id").orderBy(F.col("finished_ms").desc(), F.col("id").desc())
    return seen.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= within(n, most))


def team_form(matches: DataFrame, n: int = 10) -> DataFrame:
    """Played, won, lost and win rate over the last ``n`` finished matches."""
    won = F.count_if(F.col("winner_id") == F.col("team_id"))
    return (
        recent_matches(matches, n)
        .groupBy("team_id")
        .agg(F.count("*").alias("played"), won.alias("wins"))
        .select(
            "team_id", "played", "wins", (F.col("played") - F.col("wins")).alias("losses"),
            (F.col("wins") / F.col("played")).alias("win_rate"),
        )
    )


def last_events(events: DataFrame, n: int = 20) -> DataFrame:
    newest = Window.partitionBy("match_id").orderBy(F.col("ts_event").desc(), F.col("seq_no").desc())
    return events.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)
