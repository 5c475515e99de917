"""The driver's tables read as match telemetry (see FIXTURES.md).

One user is one match with two maps; orders are scheduled matches, line items
their maps, suppliers the teams. Only the mapping lives here. Wherever a
mapping needs an order within a user it uses chunked running aggregates, so a
user holding a third of all events is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions import running as run
from matchflow.session import cut

START_MS = 1_704_067_200_000
#: Events of a file of the stored table.
FILE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uid(number: Column) -> Column:
    """A UUID text for a number."""
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def stamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source events with ``k`` and microseconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("event_no"),
        F.col("user_id").cast("long").alias("user_id"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


def _slot_width(df: DataFrame, column: str, rows: int) -> tuple[int, int]:
    """Width of a time slot that holds about ``rows`` events of the whole table, and the number of events.

    One aggregate row reaches the driver. It only sets how finely a busy user
    is cut and how many files there are; results do not depend on it.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count("*")).first()
    return (max(1, (high - low) * rows // n) if n else 1), n


def _payload() -> Column:
    """Payload JSON by event type, as a producer would send it."""
    k, m = F.col("k"), F.col("user_id")
    a_id, b_id = uid(m % 10), uid((m % 10 + 1 + m % 9) % 10)
    teams = [a_id.alias("team_a_id"), b_id.alias("team_b_id")]
    scores = [(k % 14).alias("team_a_score"), ((k * 3) % 14).alias("team_b_score")]
    winner = F.when(F.floor(k / 2) % 2 == 0, "A").otherwise("B").alias("winner_team")
    side_a = F.when(k % 4 < 2, "CT").otherwise("T")
    side_b = F.when(k % 4 < 2, "T").otherwise("CT")
    team = F.when(k % 2 == 0, "A").otherwise("B")
    other = F.when(k % 2 == 0, "B").otherwise("A")
    player = uid(m * 100 + (k % 2) * 10 + k % 5)
    opponent = uid(m * 100 + (1 - k % 2) * 10 + F.floor(k / 5) % 5)
    weapon = F.concat(F.lit("weapon_"), (k % 6).cast("string")).alias("weapon")
    reason = F.element_at(
        F.array(*map(F.lit, ["elimination", "bomb_exploded", "bomb_defused", "time_expired"])), k % 4 + 1
    ).alias("win_reason")
    one_map = [F.concat(F.lit("map_"), (k % 7).cast("string")).alias("map_name"), F.col("map_no").alias("map_number")]

    def obj(*cols: Column) -> Column:
        return F.to_json(F.struct(*cols))

    kind = F.col("type")
    return (
        F.when(kind == "kill", obj(
            player.alias("killer_player_id"), team.alias("killer_team"),
            opponent.alias("victim_player_id"), other.alias("victim_team"), weapon,
            (k % 3 == 0).alias("is_headshot"), (k % 5 == 0).alias("is_first_kill"), *teams))
        .when(kind == "round_end", obj(
            winner, reason, *scores, (k % 6).alias("team_a_alive"), (F.floor(k / 6) % 6).alias("team_b_alive"), *teams))
        .when(kind == "round_start", obj(*scores, side_a.alias("team_a_side"), side_b.alias("team_b_side"), *teams))
        .when(kind.isin("bomb_planted", "bomb_defused", "bomb_exploded"), obj(
            player.alias("player_id"), team.alias("player_team"), F.when(k % 3 == 0, "A").otherwise("B").alias("site")))
        .when(kind == "economy_update", obj(
            (k * 160).alias("team_a_econ"), ((99 - k) * 160).alias("team_b_econ"),
            (k * 70).alias("team_a_equipment_value"), ((99 - k) * 70).alias("team_b_equipment_value")))
        .when(kind == "player_hurt", obj(
            player.alias("attacker_player_id"), team.alias("attacker_team"),
            opponent.alias("victim_player_id"), other.alias("victim_team"), k.alias("damage"), weapon))
        .when(kind == "map_start", obj(*one_map, *teams))
        .when(kind == "map_end", obj(*one_map, winner, *scores, *teams))
        .when(kind == "match_start", obj(F.lit("bo3").alias("format"), *teams))
        .otherwise(obj(winner, *teams))
    )


def events(
    spark: SparkSession, sf_dir: str, chunk_rows: int = run.CHUNK_ROWS,
    deal: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Canonical stored events.

    ``deal`` (rows, partitions) spreads the rows by match, sequence and time. It
    gets them while they are numbers, so it samples and moves no payload.
    """
    clock = _clock(spark, sf_dir)
    width, n_events = _slot_width(clock, "us", chunk_rows)
    slot = F.floor(F.col("us") / width)
    ranked = run.running(
        clock, ["user_id"], ["us", "event_no"], slot, rn=run.row_number(), n=run.whole(F.lit(1).cast("long"))
    )
    rn, n, k, kind = F.col("rn"), F.col("n"), F.col("k"), F.col("event_type")
    half = F.floor(n / 2)
    typed = cut(
        ranked.withColumn("map_no", F.when(rn * 2 <= n, 1).otherwise(2)).withColumn(
            "type",
            F.when(rn == 1, "match_start")
            .when((rn == n) & (F.col("user_id") % 3 != 0), "match_end")
            .when((rn == 2) | (rn == half + 1), "map_start")
            .when(rn == half, "map_end")
            .when(kind == "click", "kill")
            .when(kind == "view", "economy_update")
            .when(kind == "signup", "round_end")
            .when((kind == "purchase") & (k < 50), "bomb_planted")
            .when(kind == "purchase", "round_start")
            .when(k < 34, "bomb_defused")
            .when(k < 67, "bomb_exploded")
            .otherwise("player_hurt"),
        )
    )
    ended = F.when(F.col("type") == "round_end", 1).otherwise(0)
    rounds = run.running(
        typed, ["user_id", "map_no"], ["rn"], F.floor(rn / chunk_rows), ended=run.total(ended, prior=True)
    )
    placed = rounds.select("event_no", "user_id", "map_no", "ended", "k", "type", F.col("rn").cast("long").alias("seq_no"), (
        START_MS + F.col("user_id") * 420_000 + F.expr(f"(us - {START_MS * 1000}) div 20000000")).alias("ts_ms"))
    if deal is not None:
        placed = cut(placed)
    placed = placed.withColumns({"match_id": uid(F.col("user_id")), "ts_event": stamp(F.col("ts_ms"))})
    if deal is not None:
        placed = deal(placed, max(spark.sparkContext.defaultParallelism, n_events // FILE_ROWS))
    ts_ms = F.col("ts_ms")
    return placed.select(
        uid(F.col("event_no")).alias("event_id"),
        "match_id",
        uid(F.col("user_id") * 10 + F.col("map_no")).alias("map_id"),
        (F.col("ended") + 1).cast("int").alias("round_no"),
        "ts_event",
        stamp(ts_ms + k * 7).alias("ts_ingest"),
        "type",
        F.concat(F.lit("provider_"), (F.col("user_id") % 3).cast("string")).alias("source"),
        "seq_no",
        _payload().alias("payload"),
        F.concat(F.lit("trace-"), F.col("event_no").cast("string")).alias("trace_id"),
        ts_ms.cast("long").alias("version"),
    )


def with_no(df: DataFrame) -> DataFrame:
    """Event number and ``k`` back from id and ingest delay (drives the mutations)."""
    return df.withColumn("event_no", F.substring("event_id", 25, 12).cast("long")).withColumn(
        "k", ((F.unix_millis("ts_ingest") - F.unix_millis("ts_event")) / 7).cast("int")
    )


def arrivals(stored: DataFrame) -> DataFrame:
    """Events as received: copies, late rows and a jittered arrival order."""
    seen = with_no(stored)
    copies = F.when(F.col("event_no") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    late = F.when(F.col("event_no") % 50 == 0, F.col("ts_event") + F.expr("INTERVAL 5 SECONDS")).otherwise(
        F.col("ts_ingest")
    )
    return (
        seen.withColumn("copy_no", F.explode(copies))
        .withColumn("ts_ingest", late)
        .withColumn("arrival_key", F.col("seq_no") + F.col("k") % 4 + F.col("copy_no") * 3)
        .withColumn("version", F.col("version") + F.col("copy_no"))
    )


def live(stored: DataFrame, lost: bool = True) -> DataFrame:
    """Events as if all matches ran at the same time: every 97th is lost, every 50th comes 5 seconds late."""
    seen = with_no(stored).filter((F.col("event_no") % 97 != 0) | F.lit(not lost))
    before = START_MS + F.substring("match_id", 25, 12).cast("long") * 420_000
    event = F.unix_millis("ts_event") - before
    ingest = F.when(F.col("event_no") % 50 == 0, event + 5_000).otherwise(F.unix_millis("ts_ingest") - before)
    return seen.withColumns({"ts_event": stamp(event), "ts_ingest": stamp(ingest)})


def wire(seen: DataFrame, *more: str) -> DataFrame:
    """Arrived events as JSON-ready text fields, some of them malformed; further columns as they are."""
    k = F.col("k")
    return seen.select(
        *more,
        F.when(k == 99, F.concat(F.lit("bad-"), F.col("event_no").cast("string")))
        .otherwise(F.col("event_id")).alias("event_id"),
        "match_id",
        "map_id",
        F.when(k == 98, F.lit("-1")).otherwise(F.col("round_no").cast("string")).alias("round_no"),
        F.when(k == 95, F.lit("yesterday")).otherwise(iso(F.unix_millis("ts_event"))).alias("ts_event"),
        iso(F.unix_millis("ts_ingest") + F.when(F.col("event_no") % 41 == 0, 60_000).otherwise(0)).alias("ts_ingest"),
        F.when(k == 97, F.lit("unknown_type")).otherwise(F.col("type")).alias("type"),
        F.when(k == 94, F.lit("")).otherwise(F.col("source")).alias("source"),
        F.col("seq_no").cast("string").alias("seq_no"),
        F.when(k == 96, F.lit("[1,2]"))
        .when((k == 93) & (F.col("type") == "kill"), F.lit('{"killer_team":"C"}'))
        .when((k == 92), F.concat(F.lit('{"pad":"'), F.repeat(F.lit("x"), 70_000), F.lit('"}')))
        .otherwise(F.col("payload")).alias("payload"),
        "trace_id",
        F.when(k == 91, F.lit("9.9.9")).otherwise(F.lit("1.0.0")).alias("event_schema_version"),
    )


def lines(rows: DataFrame, faults: bool = False) -> Column:
    """The JSON line of wire events, numbers as numbers. With ``faults`` some fields are sent as another type."""
    k, kind = F.col("k"), F.col("type")

    def quoted(text: Column, name: str) -> Column:
        return F.regexp_replace(text, f'"{name}":([0-9a-z.]+)', f'"{name}":"$1"')

    numbers = {"round_no": "long", "seq_no": "long"}
    body = F.to_json(F.struct(*(
        F.col(c).cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in sc.WIRE.names if c != "payload")))
    payload = F.col("payload")
    if faults:
        body = F.when(k == 90, quoted(body, "round_no")).when(k == 89, quoted(body, "seq_no")).when(
            k == 88, F.regexp_replace(body, '"trace_id":"trace-([0-9]+)"', '"trace_id":$1')).otherwise(body)
        payload = (
            F.when((k == 87) & kind.isin("round_end", "round_start"), quoted(payload, "team_a_score"))
            .when((k == 86) & (kind == "kill"), quoted(quoted(payload, "is_headshot"), "is_first_kill"))
            .when((k == 85) & (kind == "economy_update"), quoted(payload, "team_b_equipment_value"))
            .when((k == 83) & kind.startswith("bomb"), F.regexp_replace(payload, "}$", ',"time_remaining_sec":"soon"}'))
            .when((k == 82) & kind.startswith("bomb"), F.regexp_replace(payload, "}$", ',"time_remaining_sec":null}'))
            .when((k == 81) & kind.startswith("bomb"), F.regexp_replace(payload, "}$", ',"time_remaining_sec":1.5}'))
            .when(k == 84, F.concat(F.lit('"'), F.regexp_replace(payload, '"', r'\\"'), F.lit('"')))
            .otherwise(payload))
    return F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',"payload":'), payload, F.lit("}"))


def requests(rows: DataFrame) -> DataFrame:
    """Wire events ``(event_no, copy_no, ...)`` as request batches; of three in a row the first is too large."""
    r = F.col("event_no") % 240
    request = F.floor(F.col("event_no") / 240) * 3 + F.when(r < 120, 0).when(r < 180, 1).otherwise(2)
    entry = F.struct("event_no", "copy_no", *sc.WIRE.names)
    return rows.groupBy(request.alias("request_no")).agg(F.sort_array(F.collect_list(entry)).alias("events"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS BIGINT) AS id", "s_name AS name", "CAST(1000 + (s_suppkey * 37) % 900 AS INT) AS rating"
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = "CAST(o_custkey % 10 AS BIGINT)"
    b = "CAST((o_custkey % 10 + 1 + o_orderkey % 9) % 10 AS BIGINT)"
    ms = "unix_millis(CAST(o_orderdate AS TIMESTAMP))"
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS id",
        f"{a} AS team_a_id",
        f"{b} AS team_b_id",
        "CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'finished' ELSE 'scheduled' END AS status",
        "CASE o_orderkey % 3 WHEN 0 THEN 'bo1' WHEN 1 THEN 'bo3' ELSE 'bo5' END AS format",
        "concat('tournament_', CAST(o_orderkey % 4 AS STRING)) AS tournament",
        f"{ms} AS scheduled_ms",
        f"CASE WHEN o_orderstatus <> 'P' THEN {ms} + 600000 END AS started_ms",
        f"CASE WHEN o_orderstatus = 'F' THEN {ms} + 7200000 + o_orderkey END AS finished_ms",
        f"CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN {a} ELSE {b} END END AS winner_id",
    )


def map_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with the team that has the higher score, if any."""
    sides = matches(spark, sf_dir).select(F.col("id").alias("match_id"), "team_a_id", "team_b_id")
    a, b = F.col("team_a_score"), F.col("team_b_score")
    winner = F.when(a > b, F.col("team_a_id")).when(a < b, F.col("team_b_id"))
    return match_maps(spark, sf_dir).join(sides, "match_id", "left").withColumn("winner_id", winner).drop(
        "team_a_id", "team_b_id")


def match_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of a match in order. Line numbers cut a match with very many maps."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("match_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = run.running(lines, ["match_id"], order, F.col("l_linenumber"), map_number=run.row_number())
    return numbered.selectExpr(
        "match_id",
        "CAST(map_number AS INT) AS map_number",
        "concat('map_', CAST(l_partkey % 7 AS STRING)) AS map_name",
        "CAST(l_quantity AS INT) % 14 AS team_a_score",
        "CAST(l_suppkey AS INT) % 14 AS team_b_score",
        "CASE WHEN map_number = 1 THEN 'live' ELSE 'scheduled' END AS status",
    )


def latency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(spark, sf_dir).selectExpr(
        "event_no AS event_id", "us div 1000 AS ts_ms", "event_type",
        "value * 0.5 AS ingest_ms", "value * 1.5 AS queue_ms", "value AS state_ms", "value * 2.0 AS predict_ms",
        "value * 5.0 AS e2e_ms", "CASE WHEN value * 5.0 <= 500 THEN 1 ELSE 0 END AS slo_met",
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(spark, sf_dir).selectExpr(
        "event_no AS request_id", "us div 1000 AS ts_ms", "user_id AS client_id", "event_type AS action",
        "value AS latency_ms",
        "CASE WHEN event_type <> 'error' THEN 200 WHEN k < 50 THEN 500 ELSE 429 END AS status_code",
        "concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(k AS STRING)) AS ip_address",
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts at one job per user, on a clock that runs 120 times as fast."""
    return _clock(spark, sf_dir).filter("event_type = 'error'").select(
        uid(F.col("user_id")).alias("event_id"),
        F.concat(F.lit("shard-"), (F.col("user_id") % 16).cast("string")).alias("shard"),
        F.expr(f"{START_MS} + (us - {START_MS * 1000}) div 120000").alias("failed_at"),
        F.col("event_no").alias("failure_no"),
    )


def scrapes(spark: SparkSession, sf_dir: str, restart: int = 90) -> DataFrame:
    """Counters and gauges of three services with two processes each, by the minute; time runs 120 times as fast.

    Every process starts its counters again after ``restart`` minutes. Only
    minutes with a request have samples. ``lag`` is what was received but not
    yet worked off, ``k % 4`` minutes later.
    """
    labels = ["service", "instance"]
    seen = _clock(spark, sf_dir).select(
        F.concat(F.lit("service_"), (F.col("user_id") % 3).cast("string")).alias("service"),
        (F.col("k") % 2).cast("long").alias("instance"), "k", "event_type", (F.col("value") * 5.0).alias("ms"),
        F.expr(f"(us - {START_MS * 1000}) div 7200000000").alias("step"),
    )
    error = F.col("event_type") == "error"
    wanted = {
        ("requests", "200"): ~error, ("requests", "500"): error & (F.col("k") < 50),
        ("requests", "429"): error & (F.col("k") >= 50),
        ("ingest_errors", "auth_invalid_signature"): F.col("k") == 99,
        **{("duration", str(le)): F.col("ms") <= le for le in sc.LATENCY_BUCKETS_MS},
        ("duration", "Infinity"): F.lit(True),
    }
    counts = seen.groupBy(*labels, "step").agg(*(F.count_if(c).alias(f"_{i}") for i, c in enumerate(wanted.values())))
    one = [F.struct(F.lit(m).alias("metric"), F.lit(x).alias("label"), F.col(f"_{i}").alias("n"))
           for i, (m, x) in enumerate(wanted)]
    started = F.floor((F.col("step") + F.col("instance") * 37) / restart)
    long = counts.select(*labels, "step", started.alias("started"), F.explode(F.array(*one)).alias("c"))
    since = Window.partitionBy("c.metric", "c.label", *labels, "started").orderBy("step")
    counters = long.select(
        "c.metric", "c.label", *labels, "step", F.sum("c.n").over(since).cast("long").alias("value"))
    moves = seen.select(*labels, F.explode(F.array(
        F.struct("step", F.lit(1).alias("n")),
        F.struct((F.col("step") + F.col("k") % 4).alias("step"), F.lit(-1).alias("n")))).alias("m"))
    change = moves.groupBy(*labels, "m.step").agg(F.sum("m.n").alias("n"))
    waiting = F.sum("n").over(Window.partitionBy(*labels).orderBy("step"))
    gauge = change.select(
        F.lit("lag").alias("metric"), F.lit("").alias("label"), *labels, "step", waiting.cast("long").alias("value"))
    return counters.unionByName(gauge)


def api_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS id",
        "c_name AS name",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'platinum' WHEN 'MACHINERY' THEN 'gold' ELSE 'silver' END AS tier",
        "c_acctbal > 0 AS is_active",
        "CASE WHEN c_custkey % 4 <> 0 THEN concat('https://client.example/', CAST(c_custkey AS STRING)) END AS webhook_url",
        "concat('mk_', lpad(CAST(c_custkey AS STRING), 8, '0')) AS key_prefix",
        "CASE c_custkey % 4 WHEN 0 THEN array('*') WHEN 1 THEN array('view:matches') WHEN 2 THEN array('click:*') "
        "ELSE array('purchase:matches', 'signup:*') END AS permissions",
        "CASE c_custkey % 3 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('10.0.1.0/24') "
        "ELSE array('10.0.2.7', '10.0.2.9', '192.168.0.0/16') END AS allowed_ips",
        "CASE WHEN c_custkey % 5 = 0 THEN 50 END AS quota_monthly",
        "sha2(concat('secret-', CAST(c_custkey AS STRING)), 256) AS key_hash",
    )


def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global row per nation and, for every third one, a row of one client."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_name AS name", "CAST(n_nationkey AS BIGINT) AS no")
    rows = F.when(F.col("no") % 3 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return nation.withColumn("own", F.explode(rows)).selectExpr(
        "name",
        "CASE WHEN own THEN no + 1 END AS client_id",
        "CASE WHEN own THEN no % 2 = 1 ELSE no % 2 = 0 END AS is_enabled",
    )
