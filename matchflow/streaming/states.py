"""State and predictions of matches while their events come in, in any order.

Events of a micro-batch join those stored before. What the batch changes in a
match lies behind the lowest sequence number it brings, so the batch runs the
batch operators, from there on, over the events of these matches. Carries, one
row per match and chunk of numbers with the state at the end of the chunk, give
the state to go on from. New rows and corrections are written under a higher
version; readers see the highest of each event. An event that comes late thus
corrects the states and predictions after it, and the end is the same in
whatever order events come.

A batch in order costs the last chunk of each of its matches. All tables lie
under the label of the batch, which a repeated batch writes anew.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow import schema as sc
from matchflow.operators import scoring
from matchflow.operators import state as st
from matchflow.operators.state import update_feed
from matchflow.session import cut
from matchflow.sources.merged import MergedTable
from matchflow.sources.store import month_number

#: Sequence numbers of a chunk: what one more event in order makes a match work through again.
CHUNK = 256

_EVENT = ["event_id", "match_id", "map_id", "round_no", "type", "seq_no", "ts_event", "ts_ingest", "payload"]


class StateTables:
    """Events, states, carries and predictions in ``out``."""

    def __init__(self, spark: SparkSession, out: str):
        none = spark.createDataFrame([], sc.RAW)
        states = st.match_state(none)
        version = T.StructField("version", T.LongType())

        def table(name: str, fields: list, key: list[str], sort: list[str]) -> MergedTable:
            return MergedTable(spark, f"{out}/{name}", T.StructType([*fields, version]), key, ["version"], sort)

        own = [sc.RAW[n] for n in _EVENT]
        chunk = T.StructField("chunk", T.LongType())
        point = [T.StructField("ms", T.LongType()), T.StructField("p", T.DoubleType())]
        event, order = ["match_id", "event_id"], ["match_id", "seq_no"]
        self.events = table("events", own, event, order)
        self.states = table("state", states.schema.fields, event, order)
        self.carries = table("carries", [chunk, *states.schema.fields], ["match_id", "chunk"], ["match_id", "chunk"])
        priced = scoring.with_odds(scoring.score(scoring.features(states)).withColumn("p_team_a_win", F.lit(0.5)))
        self.predictions = table("predictions", priced.schema.fields, ["match_id", "trigger_event_id"], order)
        self.points = table("points", [sc.RAW["match_id"], chunk, *point], ["match_id", "chunk"], ["match_id", "chunk"])


def _chunk(rows: int) -> Column:
    return F.floor(F.col("seq_no") / rows).cast("long")


def _before(table: MergedTable, changed: DataFrame, months: list[int], label: str) -> DataFrame:
    """The newest version of the last chunk before the first that changes, of each match."""
    rows = table.base(months).unionByName(table.deltas(months, but=label)).join(changed, "match_id")
    earlier = rows.filter(F.col("chunk") < F.col("low_chunk"))
    rest = [c for c in table.schema.names if c not in ("match_id", "version")]
    last = earlier.groupBy("match_id").agg(F.max_by(F.struct(*rest), F.struct("chunk", "version")).alias("r"))
    return last.select("match_id", "r.*")


def _first_month(rows: DataFrame) -> int | None:
    """Month of the earliest event, a day before: its chunk may have begun in the month before."""
    return rows.agg(month_number(F.min("ts_event") - F.expr("INTERVAL 1 DAY"))).first()[0]


def state_sink(out: str, chunk_rows: int = CHUNK) -> Callable[[DataFrame, int], None]:
    """Events of a batch to states, their update feed, and predictions."""

    known: list[StateTables] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        label = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        version = F.lit(time.time_ns() // 1_000_000)
        if not known:
            known.append(StateTables(spark, out))
        tables = known[0]

        def dated(df: DataFrame, ts: str = "ts_event") -> DataFrame:
            return df.withColumns({"version": version, "month": month_number(F.col(ts))})

        rows = cut(batch.select(*_EVENT))
        first = _first_month(rows)
        if first is None:
            return
        tables.events.write(dated(rows), label)
        low = F.min(_chunk(chunk_rows))
        changed = cut(rows.groupBy("match_id").agg(low.alias("low_chunk"), F.min("seq_no").alias("low")))
        # Later events of a changed match lie in months from its own on.
        months = [m for m in {*tables.events.open_months(), *tables.events.known_months()} if m >= first]
        stored = tables.events.read(months).join(changed, "match_id").filter(_chunk(chunk_rows) >= F.col("low_chunk"))
        old_state = _before(tables.carries, changed, months, label)
        states = cut(st.match_state(stored.select(*_EVENT), before=old_state))
        old_point = _before(tables.points, changed, months, label)
        priced = cut(scoring.predictions(states, before=old_point))

        new = states.join(changed, "match_id").filter(F.col("seq_no") >= F.col("low")).select(*states.columns)
        tables.states.write(dated(new), label)
        tables.predictions.write(dated(priced.join(changed, "match_id").filter(
            F.col("seq_no") >= F.col("low")).select(*priced.columns), "ts_calc"), label)

        def ends(df: DataFrame, *columns: Column | str) -> DataFrame:
            last = df.groupBy("match_id", _chunk(chunk_rows).alias("chunk")).agg(
                F.max_by(F.struct(*columns), "state_version").alias("r"))
            return last.select("match_id", "chunk", "r.*")

        tables.carries.write(dated(ends(states, *(c for c in states.columns if c != "match_id"))), label)
        points = ends(priced, F.unix_millis("ts_calc").alias("ms"), F.col("p_team_a_win").alias("p"), "ts_calc")
        tables.points.write(dated(points, "ts_calc"), label)
        feed(new, priced, label, out)

    return write


def feed(states: DataFrame, predictions: DataFrame, label: str, out: str) -> None:
    """Updates for subscribers: the state after each event, and each prediction."""

    def team(t: str) -> Column:
        fields = ("id", "name", "score", "maps_won", "money", "equipment_value", "alive_count", "side")
        return F.struct(*(F.col(f"team_{t}.{f}") for f in fields)).alias(f"team_{t}")

    state = F.struct("state_version", "map_id", "round_no", "phase", "bomb_planted", "seconds_remaining", team("a"), team("b"))
    odds = F.struct("state_version", "map_id", "round_no", "p_team_a_win", "p_team_b_win", "confidence", "odds_a",
                    "odds_b", "model_version", "trigger_event_id", "trigger_event_type")
    rows = update_feed(states, "state", "ts_event", state).unionByName(
        update_feed(predictions, "prediction", "ts_calc", odds))
    rows.withColumn("batch", F.lit(label)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/updates")
