"""Event model: envelope, payload fields, enumerations and limits."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# They must equal the values the event producers and API clients rely on.
EVENT_TYPES = [
    "match_start", "match_end", "map_start", "map_end", "round_start", "round_end",
    "kill", "death", "assist", "bomb_planted", "bomb_defused", "bomb_exploded",
    "player_hurt", "freeze_time_ended", "timeout_start", "timeout_end", "economy_update",
]
SIGNIFICANT_TYPES = ["round_start", "round_end", "kill", "bomb_planted", "bomb_defused", "bomb_exploded"]
PARSED_TYPES = ["kill", "economy_update", "round_end"]
TEAMS = ["A", "B"]
SIDES = ["CT", "T"]
SITES = ["A", "B"]
WIN_REASONS = ["elimination", "bomb_exploded", "bomb_defused", "time_expired"]
BUY_TYPES = ["full", "force", "eco", "pistol"]
SUPPORTED_VERSIONS = ["1.0.0"]
DEFAULT_VERSION = "1.0.0"
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_UTC_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"

MAX_EVENT_BYTES = 64 * 1024
MAX_BATCH = 100
MAX_ROUND = 50
MAX_SKEW_MS = 30_000
MAX_FUTURE_MS = 5_000
MAX_LATENESS_MS = 2_000
SEQ_GAP = 10
SEQ_BUFFER = 100
DEDUP_HOURS = 2
STREAM_KEEP = 50_000
DEAD_LETTER_KEEP = 10_000
MAX_RETRIES = 3
SHARDS = 16
MAX_PAGE = 100
RETENTION_DAYS = {"raw": 90, "parsed": 180, "predictions": 180, "rounds": 90, "audit": 365, "latency": 30}
TIER_RETENTION_DAYS = {"silver": 7, "gold": 30, "platinum": 365}
TIER_MONTHLY_QUOTA = {"silver": 10_000_000, "gold": 100_000_000}  # platinum: no limit
LATENCY_BUCKETS_MS = [50, 100, 200, 300, 400, 500, 750, 1000, 2000]
LATENCY_TARGET_MS, LATENCY_WARNING_MS = 500, 300
ERROR_TARGET_PCT, ERROR_WARNING_PCT = 0.1, 0.05
HALF_ROUNDS, REGULATION_ROUNDS, PLAYERS, BOMB_SECONDS = 12, 24, 5, 40
# ----------------------------------------------------------------------------

S, I, L, B, D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# What a producer sends: one JSON object per line. Times are ISO 8601 text.
WIRE = _struct(
    event_id=S, match_id=S, map_id=S, round_no=S, ts_event=S, ts_ingest=S, type=S, source=S,
    seq_no=S, payload=S, trace_id=S, event_schema_version=S,
)

# What is stored.
RAW = _struct(
    event_id=S, match_id=S, map_id=S, round_no=I, ts_event=T.TimestampType(), ts_ingest=T.TimestampType(),
    type=S, source=S, seq_no=L, payload=S, trace_id=S, version=L,
)

# Every payload field any operator reads. Readers take the part they need, so
# one parse per event serves all of an operator's columns.
PAYLOAD = {
    "killer_player_id": S, "killer_team": S, "victim_player_id": S, "victim_team": S, "weapon": S,
    "is_headshot": B, "is_first_kill": B,
    "winner_team": S, "win_reason": S, "team_a_score": L, "team_b_score": L, "team_a_alive": L, "team_b_alive": L,
    "team_a_econ": L, "team_b_econ": L, "team_a_equipment_value": L, "team_b_equipment_value": L,
    "team_a_buy_type": S, "team_b_buy_type": S,
    "player_id": S, "player_team": S, "site": S, "time_remaining_sec": D,
    "attacker_player_id": S, "attacker_team": S, "damage": L,
    "team_a_side": S, "team_b_side": S, "team_a_id": S, "team_b_id": S, "team_a_name": S, "team_b_name": S,
    "map_name": S, "map_number": L, "format": S, "tournament": S,
}


def payload_type(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, PAYLOAD[n]) for n in names])
