"""Validation of received events, quarantine and batch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions.scalars import shard_number

_DIGITS = r"^\d{1,18}$"


def _uuid(name: str) -> Column:
    return F.col(name).rlike(sc.UUID_PATTERN)


def _time(name: str) -> Column:
    return F.col(name).rlike(sc.ISO_UTC_PATTERN) & F.try_to_timestamp(F.col(name)).isNotNull()


def _whole(name: str, top: int | None = None) -> Column:
    ok = F.col(name).rlike(_DIGITS)
    return ok & (F.col(name).try_cast("long") <= top) if top is not None else ok


def _length(name: str, top: int) -> Column:
    return F.length(name).between(1, top)


def _object(name: str) -> Column:
    return F.col(name).rlike(r"^\s*\{") & F.get_json_object(name, "$").isNotNull()


def _failed(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _codes(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold."""
    return F.array_compact(F.array(*(F.when(_failed(ok), F.lit(code)) for code, ok in rules.items())))


def envelope_rules(strict: bool) -> dict[str, Column]:
    """Rules on the wire form, where every field is text."""
    rules = {
        "event_id": _uuid("event_id"),
        "match_id": _uuid("match_id"),
        "map_id": _uuid("map_id"),
        "round_no": _whole("round_no", sc.MAX_ROUND if strict else None),
        "ts_event": _time("ts_event"),
        "type": _length("type", 50) if strict else F.col("type").isin(sc.EVENT_TYPES),
        "source": _length("source", 100) if strict else F.col("source").isNotNull(),
        "seq_no": _whole("seq_no"),
        "payload": _object("payload"),
    }
    if strict:
        rules |= {
            "ts_ingest": F.col("ts_ingest").isNull() | _time("ts_ingest"),
            "version": F.coalesce("event_schema_version", F.lit(sc.DEFAULT_VERSION)).isin(sc.SUPPORTED_VERSIONS),
        }
    return rules


def size_rule(columns: list[str], max_bytes: int = sc.MAX_EVENT_BYTES) -> Column:
    """The event as one line; the payload is text already and counts as it is, not with its quotes escaped."""
    rest = F.octet_length(F.to_json(F.struct(*(c for c in columns if c != "payload"))))
    if "payload" in columns:
        rest = rest + F.coalesce(F.octet_length("payload") + F.lit(len(',"payload":')), F.lit(0))
    return rest <= max_bytes


def skew_errors(event: Column, ingest: Column, skew_ms: int = sc.MAX_SKEW_MS) -> Column:
    """``clock_skew`` when the clocks differ too much or one is unreadable,
    ``from_future`` when the event is ahead of its intake."""
    ahead = F.unix_millis(event) - F.unix_millis(ingest)
    return F.array_compact(F.array(
        F.when(ahead.isNull() | (F.abs(ahead) > skew_ms), F.lit("clock_skew")),
        F.when(ahead > sc.MAX_FUTURE_MS, F.lit("from_future")),
    ))


def payload_rules() -> dict[str, dict[str, Column]]:
    """Rules on the parsed payload ``p`` by event type; other types are free."""

    def given(name: str) -> Column:
        return F.col(f"p.{name}").isNotNull()

    def one_of(name: str, values: list[str], optional: bool = False) -> Column:
        ok = F.coalesce(F.col(f"p.{name}").isin(values), F.lit(False))
        return ok | F.col(f"p.{name}").isNull() if optional else ok

    def natural(name: str) -> Column:
        return F.col(f"p.{name}") >= 0

    both = ("team_a", "team_b")
    scores = {f"{t}_score": natural(f"{t}_score") for t in both}
    ids = {f"{t}_id": given(f"{t}_id") for t in both}
    bomb = {
        "player_id": given("player_id"),
        "player_team": one_of("player_team", sc.TEAMS),
        "site": one_of("site", sc.SITES),
    }
    return {
        "kill": {
            "killer_player_id": given("killer_player_id"),
            "killer_team": one_of("killer_team", sc.TEAMS),
            "victim_player_id": given("victim_player_id"),
            "victim_team": one_of("victim_team", sc.TEAMS),
            "weapon": given("weapon"),
            "is_headshot": given("is_headshot"),
        },
        "round_end": {
            "winner_team": one_of("winner_team", sc.TEAMS),
            "win_reason": one_of("win_reason", sc.WIN_REASONS),
            **scores,
            **ids,
        },
        "round_start": {**scores, **{f"{t}_side": one_of(f"{t}_side", sc.SIDES) for t in both}, **ids},
        "bomb_planted": bomb,
        "bomb_defused": bomb,
        "bomb_exploded": bomb,
        "economy_update": {
            **{f"{t}_econ": natural(f"{t}_econ") for t in both},
            **{f"{t}_buy_type": one_of(f"{t}_buy_type", sc.BUY_TYPES, optional=True) for t in both},
        },
    }


def payload_errors(kind: str = "type") -> Column:
    checks = F.lit(None).cast("array<string>")
    for name, rules in payload_rules().items():
        checks = F.when(F.col(kind) == name, _codes(rules)).otherwise(checks)
    return F.transform(F.coalesce(checks, F.array().cast("array<string>")), lambda c: F.concat(F.lit("payload."), c))


_TYPED = [
    "killer_player_id", "killer_team", "victim_player_id", "victim_team", "weapon", "is_headshot", "winner_team",
    "win_reason", "team_a_score", "team_b_score", "team_a_id", "team_b_id", "team_a_side", "team_b_side",
    "player_id", "player_team", "site", "team_a_econ", "team_b_econ", "team_a_buy_type", "team_b_buy_type",
]


# JSON types of fields as they must be sent; "?" marks those that may be absent.
ENVELOPE_SENT = {
    "event_id": "text", "match_id": "text", "map_id": "text", "round_no": "whole", "ts_event": "text", "type": "text",
    "source": "text", "seq_no": "whole", "payload": "object", "ts_ingest": "text?", "trace_id": "text?",
    "event_schema_version": "text?",
}
_BOMB_SENT = {"player_id": "text", "player_team": "text", "site": "text", "time_remaining_sec": "number?"}
_SCORES_SENT = {"team_a_score": "whole", "team_b_score": "whole", "team_a_id": "text", "team_b_id": "text"}
PAYLOAD_SENT = {
    "kill": {
        "killer_player_id": "text", "killer_team": "text", "victim_player_id": "text", "victim_team": "text",
        "weapon": "text", "is_headshot": "flag",
        **dict.fromkeys(
            ["is_wallbang", "is_through_smoke", "is_no_scope", "is_first_kill", "attacker_blind"], "flag?"),
    },
    "round_end": {"winner_team": "text", "win_reason": "text", **_SCORES_SENT},
    "round_start": {"team_a_side": "text", "team_b_side": "text", **_SCORES_SENT},
    "bomb_planted": _BOMB_SENT, "bomb_defused": _BOMB_SENT, "bomb_exploded": _BOMB_SENT,
    "economy_update": {
        "team_a_econ": "whole", "team_b_econ": "whole", "team_a_equipment_value": "whole?",
        "team_b_equipment_value": "whole?", "team_a_buy_type": "text?", "team_b_buy_type": "text?",
    },
}


def read_lines(lines: DataFrame, *more: str, column: str = "value", sent: str = "sent") -> DataFrame:
    """Wire events of JSON lines, the line as a variant in ``sent``, and further columns as they are.

    The wire columns are text whatever was sent; the variant still knows that
    ``"5"`` is text and ``5`` a number. A line that is no JSON object has nulls.
    """
    parsed = lines.select(F.from_json(column, sc.WIRE).alias("e"), F.try_parse_json(column).alias(sent), *more)
    return parsed.select("e.*", sent, *more)


def _sent_as(sent: str, path: str, kind: str) -> Column:
    """Whether the field at ``path`` has the JSON type. A null is not an absent field."""
    value = F.try_variant_get(F.col(sent), path, "variant")
    name = F.schema_of_variant(value)
    amount = F.try_variant_get(F.col(sent), path, "double")
    number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    ok = {
        "text": name == "STRING",
        "flag": name == "BOOLEAN",
        "object": name.startswith("OBJECT"),
        "number": number,
        "whole": (name == "BIGINT") | (number & (amount == F.floor(amount))),
    }[kind.removesuffix("?")]
    return ok | name.isNull() if kind.endswith("?") else ok


def sent_errors(sent: str, typed: bool) -> Column:
    """Codes of fields sent with another JSON type; those of the payload only where it is an object."""
    codes = _codes({f: _sent_as(sent, f"$.{f}", kind) for f, kind in ENVELOPE_SENT.items()})
    if not typed:
        return codes
    inner = F.lit(None).cast("array<string>")
    for event, fields in PAYLOAD_SENT.items():
        found = _codes({f"payload.{f}": _sent_as(sent, f"$.payload.{f}", kind) for f, kind in fields.items()})
        inner = F.when(F.col("type") == event, found).otherwise(inner)
    none = F.array().cast("array<string>")
    return F.concat(codes, F.when(F.array_contains(codes, "payload"), none).otherwise(F.coalesce(inner, none)))


def validate(
    events: DataFrame,
    strict: bool = False,
    typed: bool = False,
    max_bytes: int = sc.MAX_EVENT_BYTES,
    skew_ms: int | None = None,
    sent: str | None = None,
) -> DataFrame:
    """Wire events with an ``errors`` array (empty when valid).

    ``strict`` adds length, version and size limits, ``typed`` the payload
    rules of the event's type, ``skew_ms`` the clock check, ``sent`` (the
    variant of ``read_lines``, dropped here) the JSON types.
    """
    rules = envelope_rules(strict)
    if strict:
        rules["size"] = size_rule([c for c in events.columns if c in sc.WIRE.names], max_bytes)
    errors = [_codes(rules)]
    if skew_ms is not None:
        errors.append(skew_errors(
            F.try_to_timestamp(F.col("ts_event")), F.try_to_timestamp(F.col("ts_ingest")), skew_ms
        ))
    if typed:
        events = events.withColumn("p", F.from_json("payload", sc.payload_type(*_TYPED)))
        errors.append(payload_errors())
    if sent is not None:
        errors.append(sent_errors(sent, typed))
    found = F.concat(*errors)
    # Through a generator of one row: a filter on the errors then stays behind it, where the payload is
    # parsed once and every rule is tried once. Pushed into the scan, it would parse again for each rule.
    errors = F.explode(F.array(found if sent is None else F.array_distinct(found))).alias("errors")
    kept = [c for c in events.columns if c not in ("p", sent, "errors")]
    return events.select(*kept, errors)


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events and the rest."""
    bad = F.size("errors") > 0
    return validated.filter(~bad).drop("errors"), validated.filter(bad)


def typed_events(valid: DataFrame, *more: str) -> DataFrame:
    """Valid wire events as stored events, and further columns as they are."""
    ts = F.try_to_timestamp(F.col("ts_event"))
    return valid.select(
        *more, "event_id", "match_id", "map_id",
        F.col("round_no").cast("int").alias("round_no"),
        ts.alias("ts_event"),
        F.coalesce(F.try_to_timestamp(F.col("ts_ingest")), F.current_timestamp()).alias("ts_ingest"),
        "type", "source",
        F.col("seq_no").cast("long").alias("seq_no"),
        "payload",
        F.coalesce("trace_id", F.uuid()).alias("trace_id"),
        F.unix_millis(ts).alias("version"),
    )


def quarantine(bad: DataFrame) -> DataFrame:
    """Dead-letter rows of rejected events."""
    event = F.to_json(F.struct(*(c for c in bad.columns if c != "errors")))
    return bad.select(
        "event_id",
        F.concat_ws(":", "match_id", "map_id").alias("shard"),
        shard_number(F.col("match_id"), F.col("map_id")).alias("shard_no"),
        F.concat_ws(",", "errors").alias("error"),
        F.lit(0).alias("retry_count"),
        F.col("ts_ingest").alias("first_failed_at"),
        F.col("ts_ingest").alias("last_failed_at"),
        event.alias("event"),
    )


def explode_batches(batches: DataFrame, column: str = "events", limit: int = sc.MAX_BATCH) -> DataFrame:
    """Events of request batches with their place ``pos``; every event of an oversized batch is rejected."""
    rows = batches.withColumn("oversized", F.size(column) > limit)
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.posexplode(column).alias("pos", "e")).select("e.*", *rest, "pos")


def batch_results(validated: DataFrame, order: list[str]) -> DataFrame:
    """The answer for each item of a batch: taken, a duplicate of one taken before it in ``order``, or why not.

    Items of oversized batches are refused as they come and make no other
    item a duplicate. The first item of an event is found by a hash
    aggregate over places, so copies are combined before they are shuffled.
    """
    keys = ["match_id", "event_id"]
    ok = ~F.col("oversized") & (F.size("errors") == 0)
    place = F.struct(*order)
    firsts = validated.filter(ok).groupBy(*keys).agg(F.min(place).alias("__first"))
    rows = validated.withColumns({"__ok": ok, "__place": place}).join(firsts, keys, "left")
    duplicate = F.col("__ok") & (F.col("__place") != F.col("__first"))
    error = F.when(F.col("oversized"), "BATCH_TOO_LARGE").when(~F.col("__ok"), "Validation failed")
    return rows.select(
        *order, F.coalesce("event_id", F.lit("unknown")).alias("event_id"), F.col("__ok").alias("success"),
        F.coalesce(duplicate, F.lit(False)).alias("duplicate"), error.alias("error"))


def batch_totals(results: DataFrame, request: str) -> DataFrame:
    """Items, taken ones, duplicates and errors per request."""
    return results.groupBy(request).agg(
        F.count("*").alias("total"), F.count_if(F.col("success") & ~F.col("duplicate")).alias("processed"),
        F.count_if(F.col("duplicate")).alias("duplicates"), F.count_if(~F.col("success")).alias("errors"),
    )


def batch_outcomes(validated: DataFrame) -> DataFrame:
    """How many events were processed, duplicates of one processed, or errors.

    Copies are counted per event before outcomes are summed, so an event sent
    very often costs one partial count per task.
    """
    per_event = validated.groupBy("event_id", (F.size("errors") > 0).alias("bad")).agg(F.count("*").alias("n"))
    pair = F.when(F.col("bad"), F.array(F.struct(F.lit("error").alias("outcome"), F.col("n")))).otherwise(
        F.array(
            F.struct(F.lit("processed").alias("outcome"), F.lit(1).cast("long").alias("n")),
            F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - 1).alias("n")),
        )
    )
    rows = per_event.select(F.explode(pair).alias("o")).select("o.*")
    return rows.groupBy("outcome").agg(F.sum("n").alias("events"))


def processing_outcomes(validated: DataFrame) -> DataFrame:
    """Processed, failed and duplicate events per provider, with mean intake delay.

    Delays are summed per event and status first, for the same reason.
    """
    delay = F.unix_millis(F.try_to_timestamp(F.col("ts_ingest"))) - F.unix_millis(F.try_to_timestamp(F.col("ts_event")))
    per_event = validated.groupBy("source", "event_id", (F.size("errors") > 0).alias("bad")).agg(
        F.count("*").alias("n"), F.sum(delay).alias("total"), F.min(delay).alias("first"),
        F.count(delay).alias("timed"),
    )

    def row(status: str, n: Column, total: Column, timed: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"), n.cast("long").alias("n"), total.cast("long").alias("total"),
            timed.cast("long").alias("timed"),
        )

    one = F.lit(1)
    rows = F.when(F.col("bad"), F.array(row("failed", F.col("n"), F.col("total"), F.col("timed")))).otherwise(F.array(
        row("processed", one, F.col("first"), one),
        row("duplicate", F.col("n") - 1, F.col("total") - F.col("first"), F.col("timed") - 1),
    ))
    spread = per_event.select("source", F.explode(rows).alias("r")).select("source", "r.*").filter("n > 0")
    return spread.groupBy(F.col("source").alias("processor"), "status").agg(
        F.sum("n").alias("events"), F.try_divide(F.sum("total"), F.sum("timed")).alias("avg_latency_ms")
    )


def ingestion_errors(bad: DataFrame, resolved: Column) -> DataFrame:
    """Errors by provider and code with those not resolved yet."""
    rows = bad.withColumn("resolved", resolved).select("source", "resolved", F.explode("errors").alias("error_code"))
    return rows.groupBy("source", "error_code").agg(
        F.count("*").alias("errors"), F.count_if(~F.col("resolved")).alias("pending")
    )
