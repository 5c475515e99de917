"""SQL twins of the queries, in DuckDB's dialect over the same tables."""

from __future__ import annotations

UID = "'00000000-0000-4000-8000-' || lpad(CAST({} AS VARCHAR), 12, '0')"


def uid(x: str) -> str:
    return "(" + UID.format(x) + ")"


# --- Fixture tables -----------------------------------------------------------
FX = f"""
b AS (
  SELECT event_id, user_id, event_type, value, CAST(props->>'k' AS INT) AS k,
    1704067200000 + user_id * 420000 + CAST((epoch_us(ts) - 1704067200000000) // 20000000 AS BIGINT) AS ts_event_ms,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
t AS (
  SELECT *, CASE WHEN rn * 2 <= n THEN 1 ELSE 2 END AS map_no,
    CASE WHEN rn = 1 THEN 'match_start' WHEN rn = n AND user_id % 3 <> 0 THEN 'match_end'
      WHEN rn = 2 OR rn = n // 2 + 1 THEN 'map_start' WHEN rn = n // 2 THEN 'map_end'
      WHEN event_type = 'click' THEN 'kill' WHEN event_type = 'view' THEN 'economy_update'
      WHEN event_type = 'signup' THEN 'round_end'
      WHEN event_type = 'purchase' THEN CASE WHEN k < 50 THEN 'bomb_planted' ELSE 'round_start' END
      WHEN k < 34 THEN 'bomb_defused' WHEN k < 67 THEN 'bomb_exploded' ELSE 'player_hurt' END AS type
  FROM b),
ev AS (
  SELECT CAST(event_id AS BIGINT) AS event_no, CAST(user_id AS BIGINT) AS m, map_no, k, type, value,
    {uid('event_id')} AS event_id, {uid('user_id')} AS match_id, {uid('user_id * 10 + map_no')} AS map_id,
    CAST(rn AS BIGINT) AS seq_no, ts_event_ms, ts_event_ms + k * 7 AS ts_ingest_ms,
    'provider_' || CAST(user_id % 3 AS VARCHAR) AS source, 'trace-' || CAST(event_id AS VARCHAR) AS trace_id,
    CAST(1 + coalesce(sum(CASE WHEN type = 'round_end' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, map_no
      ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS round_no,
    CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS killer_team,
    CASE WHEN k % 2 = 0 THEN 'B' ELSE 'A' END AS victim_team,
    {uid('user_id * 100 + (k % 2) * 10 + k % 5')} AS killer_player_id,
    {uid('user_id * 100 + (1 - k % 2) * 10 + (k // 5) % 5')} AS victim_player_id,
    'weapon_' || CAST(k % 6 AS VARCHAR) AS weapon, k % 3 = 0 AS is_headshot, k % 5 = 0 AS is_first_kill,
    CASE WHEN (k // 2) % 2 = 0 THEN 'A' ELSE 'B' END AS winner_team,
    CASE k % 4 WHEN 0 THEN 'elimination' WHEN 1 THEN 'bomb_exploded' WHEN 2 THEN 'bomb_defused'
      ELSE 'time_expired' END AS win_reason,
    CAST(k % 14 AS BIGINT) AS score_a, CAST((k * 3) % 14 AS BIGINT) AS score_b,
    CAST(k % 6 AS BIGINT) AS alive_a, CAST((k // 6) % 6 AS BIGINT) AS alive_b,
    CASE WHEN k % 4 < 2 THEN 'CT' ELSE 'T' END AS side_a, CASE WHEN k % 4 < 2 THEN 'T' ELSE 'CT' END AS side_b,
    CAST(k * 160 AS BIGINT) AS econ_a, CAST((99 - k) * 160 AS BIGINT) AS econ_b,
    CAST(k * 70 AS BIGINT) AS equip_a, CAST((99 - k) * 70 AS BIGINT) AS equip_b, CAST(k AS BIGINT) AS damage
  FROM t)"""

ARR = """
arr AS (
  SELECT ev.* EXCLUDE (ts_ingest_ms), c.copy_no, ts_event_ms + c.copy_no AS version,
    CASE WHEN event_no % 50 = 0 THEN ts_event_ms + 5000 ELSE ts_ingest_ms END AS ts_ingest_ms,
    seq_no + k % 4 + c.copy_no * 3 AS arrival_key
  FROM ev JOIN (SELECT 0 AS copy_no UNION ALL SELECT 1) AS c ON c.copy_no = 0 OR ev.event_no % 20 = 0)"""

WIRE = """
wr AS (
  SELECT arr.* EXCLUDE (event_id, ts_ingest_ms, type, source),
    CASE WHEN k = 99 THEN 'bad-' || CAST(event_no AS VARCHAR) ELSE event_id END AS event_id,
    type AS real_type, CASE WHEN k = 97 THEN 'unknown_type' ELSE type END AS type,
    CASE WHEN k = 94 THEN '' ELSE source END AS source,
    ts_ingest_ms + CASE WHEN event_no % 41 = 0 THEN 60000 ELSE 0 END AS ts_ingest_ms,
    CASE k WHEN 99 THEN 'event_id' WHEN 98 THEN 'round_no' WHEN 95 THEN 'ts_event' WHEN 97 THEN 'type'
      WHEN 96 THEN 'payload' END AS plain_error,
    CASE WHEN k = 99 THEN 'event_id' WHEN k = 98 OR round_no > 50 THEN 'round_no' WHEN k = 95 THEN 'ts_event'
      WHEN k = 94 THEN 'source' WHEN k = 96 THEN 'payload' WHEN k = 91 THEN 'version' WHEN k = 92 THEN 'size'
      END AS strict_error,
    CASE WHEN k = 95 OR (ts_ingest_ms + CASE WHEN event_no % 41 = 0 THEN 60000 ELSE 0 END - ts_event_ms) > 30000
      THEN 'clock_skew' END AS skew_error,
    CASE WHEN k IN (92, 96) OR (k = 93 AND type = 'kill') THEN
      CASE CASE WHEN k = 97 THEN 'unknown_type' ELSE type END
      WHEN 'kill' THEN 'payload.killer_player_id,payload.killer_team,payload.victim_player_id,payload.victim_team,payload.weapon,payload.is_headshot'
      WHEN 'round_end' THEN 'payload.winner_team,payload.win_reason,payload.team_a_score,payload.team_b_score,payload.team_a_id,payload.team_b_id'
      WHEN 'round_start' THEN 'payload.team_a_score,payload.team_b_score,payload.team_a_side,payload.team_b_side,payload.team_a_id,payload.team_b_id'
      WHEN 'bomb_planted' THEN 'payload.player_id,payload.player_team,payload.site'
      WHEN 'bomb_defused' THEN 'payload.player_id,payload.player_team,payload.site'
      WHEN 'bomb_exploded' THEN 'payload.player_id,payload.player_team,payload.site'
      WHEN 'economy_update' THEN 'payload.team_a_econ,payload.team_b_econ' END END AS payload_error
  FROM arr)"""

TEAMS = """
teams AS (
  SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, CAST(1000 + (s_suppkey * 37) % 900 AS INT) AS rating
  FROM supplier)"""

MATCHES = """
ma AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 10 AS BIGINT) AS team_a_id,
    CAST((o_custkey % 10 + 1 + o_orderkey % 9) % 10 AS BIGINT) AS team_b_id,
    CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'finished' ELSE 'scheduled' END AS status,
    CASE o_orderkey % 3 WHEN 0 THEN 'bo1' WHEN 1 THEN 'bo3' ELSE 'bo5' END AS format,
    'tournament_' || CAST(o_orderkey % 4 AS VARCHAR) AS tournament,
    epoch_ms(o_orderdate) AS scheduled_ms,
    CASE WHEN o_orderstatus <> 'P' THEN epoch_ms(o_orderdate) + 600000 END AS started_ms,
    CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + 7200000 + o_orderkey END AS finished_ms,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 10 AS BIGINT)
      ELSE CAST((o_custkey % 10 + 1 + o_orderkey % 9) % 10 AS BIGINT) END END AS winner_id
  FROM orders)"""

MAPS = """
mm AS (
  SELECT match_id, map_number, map_name, team_a_score, team_b_score,
    CASE WHEN map_number = 1 THEN 'live' ELSE 'scheduled' END AS status FROM (
    SELECT CAST(l_orderkey AS BIGINT) AS match_id,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
        AS INT) AS map_number,
      'map_' || CAST(l_partkey % 7 AS VARCHAR) AS map_name, CAST(l_quantity AS INT) % 14 AS team_a_score,
      CAST(l_suppkey AS INT) % 14 AS team_b_score FROM lineitem) AS z)"""

LATENCY = """
lat AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value * 0.5 AS ingest_ms,
    value * 1.5 AS queue_ms, value AS state_ms, value * 2.0 AS predict_ms, value * 5.0 AS e2e_ms FROM events)"""

AUDIT = """
aud AS (
  SELECT CAST(event_id AS BIGINT) AS request_id, epoch_us(ts) // 1000 AS ts_ms, CAST(user_id AS BIGINT) AS client_id,
    event_type AS action, value AS latency_ms, CASE WHEN event_type <> 'error' THEN 200
      WHEN CAST(props->>'k' AS INT) < 50 THEN 500 ELSE 429 END AS status_code,
    '10.0.' || CAST(user_id % 3 AS VARCHAR) || '.' || CAST(CAST(props->>'k' AS INT) AS VARCHAR) AS ip_address
  FROM events)"""

CLIENTS = """
cl AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'platinum'
      WHEN 'MACHINERY' THEN 'gold' ELSE 'silver' END AS tier, c_acctbal > 0 AS is_active,
    c_custkey % 4 <> 0 AS has_webhook, 'mk_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key_prefix,
    CASE WHEN c_custkey % 5 = 0 THEN 50 END AS quota_monthly
  FROM customer)"""

# State fold in its window form (one row per event).
STATE = """
sg AS (
  SELECT *, sum(CASE WHEN type = 'map_start' THEN 1 ELSE 0 END) OVER w AS map_seg,
    sum(CASE WHEN type = 'match_start' THEN 1 ELSE 0 END) OVER w AS match_seg,
    sum(CASE WHEN type = 'round_start' THEN 1 ELSE 0 END) OVER w AS live_seg,
    sum(CASE WHEN type = 'round_end' AND winner_team = 'A' THEN 1 ELSE 0 END) OVER w AS a_won,
    sum(CASE WHEN type = 'round_end' AND winner_team = 'B' THEN 1 ELSE 0 END) OVER w AS b_won
  FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY seq_no ROWS UNBOUNDED PRECEDING)),
st AS (
  SELECT match_id, event_id, event_no, m, type, seq_no, ts_event_ms, k,
    coalesce(last_value(CASE WHEN type = 'map_start' THEN map_id END IGNORE NULLS) OVER w,
      first_value(map_id) OVER w) AS map_id,
    row_number() OVER (PARTITION BY match_id ORDER BY seq_no) AS state_version,
    CAST(max(CASE WHEN type = 'map_start' THEN 1 ELSE round_no END) OVER (PARTITION BY match_id, map_seg
      ORDER BY seq_no ROWS UNBOUNDED PRECEDING) AS INT) AS round_no,
    coalesce(last_value(CASE WHEN type = 'round_start' THEN 'live' WHEN type = 'bomb_planted' THEN 'bomb_planted'
      WHEN type IN ('bomb_defused', 'bomb_exploded', 'round_end') THEN 'ended' END IGNORE NULLS) OVER w, 'warmup') AS phase,
    coalesce(last_value(CASE WHEN type = 'round_start' THEN false WHEN type = 'bomb_planted' THEN true END IGNORE NULLS)
      OVER w, false) AS bomb_planted,
    CASE WHEN sum(CASE WHEN type = 'bomb_planted' THEN 1 ELSE 0 END) OVER w > 0 THEN 40 ELSE 0 END AS seconds_remaining,
    CAST(sum(CASE WHEN type = 'round_end' AND winner_team = 'A' THEN 1 ELSE 0 END) OVER ms AS BIGINT) AS a_score,
    CAST(sum(CASE WHEN type = 'round_end' AND winner_team = 'B' THEN 1 ELSE 0 END) OVER ms AS BIGINT) AS b_score,
    CAST(sum(CASE WHEN type = 'map_end' AND winner_team = 'A' THEN 1 ELSE 0 END) OVER ts AS BIGINT) AS a_maps_won,
    CAST(sum(CASE WHEN type = 'map_end' AND winner_team = 'B' THEN 1 ELSE 0 END) OVER ts AS BIGINT) AS b_maps_won,
    CAST(coalesce(last_value(CASE WHEN type = 'economy_update' THEN econ_a END IGNORE NULLS) OVER w, 0) AS BIGINT) AS a_money,
    CAST(coalesce(last_value(CASE WHEN type = 'economy_update' THEN econ_b END IGNORE NULLS) OVER w, 0) AS BIGINT) AS b_money,
    CAST(coalesce(last_value(CASE WHEN type = 'economy_update' THEN equip_a END IGNORE NULLS) OVER w, 0) AS BIGINT) AS a_equipment_value,
    CAST(coalesce(last_value(CASE WHEN type = 'economy_update' THEN equip_b END IGNORE NULLS) OVER w, 0) AS BIGINT) AS b_equipment_value,
    CAST(b_won - min(b_won) OVER (PARTITION BY match_id, a_won ORDER BY seq_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS a_consecutive_round_losses,
    CAST(a_won - min(a_won) OVER (PARTITION BY match_id, b_won ORDER BY seq_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b_consecutive_round_losses,
    coalesce(last_value(CASE WHEN type = 'round_start' THEN side_a END IGNORE NULLS) OVER w, 'CT') AS a_side,
    coalesce(last_value(CASE WHEN type = 'round_start' THEN side_b END IGNORE NULLS) OVER w, 'CT') AS b_side,
    CAST(greatest(0, 5 - sum(CASE WHEN type = 'kill' AND victim_team = 'A' THEN 1 ELSE 0 END) OVER ls) AS BIGINT) AS a_alive_count,
    CAST(greatest(0, 5 - sum(CASE WHEN type = 'kill' AND victim_team = 'B' THEN 1 ELSE 0 END) OVER ls) AS BIGINT) AS b_alive_count
  FROM sg
  WINDOW w AS (PARTITION BY match_id ORDER BY seq_no ROWS UNBOUNDED PRECEDING),
    ms AS (PARTITION BY match_id, map_seg ORDER BY seq_no ROWS UNBOUNDED PRECEDING),
    ts AS (PARTITION BY match_id, match_seg ORDER BY seq_no ROWS UNBOUNDED PRECEDING),
    ls AS (PARTITION BY match_id, live_seg ORDER BY seq_no ROWS UNBOUNDED PRECEDING))"""

STATE_OUT = """match_id, map_id, state_version, round_no, phase, bomb_planted, seconds_remaining,
  a_score, a_maps_won, a_money, a_equipment_value, a_consecutive_round_losses, a_side, a_alive_count,
  b_score, b_maps_won, b_money, b_equipment_value, b_consecutive_round_losses, b_side, b_alive_count"""

FEATURES = """
ft AS (
  SELECT *, greatest(-1.0, least(1.0, (a_money - b_money) / 10000.0::DOUBLE)) AS econ_diff,
    greatest(-1.0, least(1.0, (a_equipment_value - b_equipment_value) / 10000.0::DOUBLE)) AS equip_diff,
    a_alive_count - b_alive_count AS alive_diff, b_consecutive_round_losses AS win_streak_a,
    a_consecutive_round_losses AS win_streak_b, 0.0::DOUBLE AS strength_diff
  FROM st),
sc AS (
  SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, greatest(0.05::DOUBLE, least(0.95::DOUBLE,
      0.5::DOUBLE + strength_diff * 0.1::DOUBLE + alive_diff * 0.15::DOUBLE + equip_diff * 0.05::DOUBLE
      + CASE WHEN NOT bomb_planted THEN 0.0::DOUBLE WHEN a_side = 'T' THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END
      + (win_streak_a - win_streak_b) * 0.02::DOUBLE)))) AS p_raw,
    greatest(0.1::DOUBLE, least(0.95::DOUBLE, 1 - (a_alive_count + b_alive_count) / 10.0::DOUBLE
      + CASE WHEN bomb_planted THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS confidence
  FROM ft)"""

# The limiter, prediction by prediction.
PRED = """
sp AS (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY seq_no) AS pn FROM sc
  WHERE type IN ('round_start', 'round_end', 'kill', 'bomb_planted', 'bomb_defused', 'bomb_exploded')),
lim AS (
  SELECT match_id, pn, ts_event_ms, p_raw AS p FROM sp WHERE pn = 1
  UNION ALL
  SELECT sp.match_id, sp.pn, sp.ts_event_ms, CASE
      WHEN sp.ts_event_ms <= lim.ts_event_ms THEN sp.p_raw
      WHEN abs(sp.p_raw - lim.p) <= 0.2::DOUBLE * ((sp.ts_event_ms - lim.ts_event_ms) / 1000.0::DOUBLE) + 0.05::DOUBLE
        THEN sp.p_raw
      WHEN abs(sp.p_raw - lim.p) <= 0.2::DOUBLE + 0.05::DOUBLE * ((sp.ts_event_ms - lim.ts_event_ms) / 1000.0::DOUBLE)
        THEN sp.p_raw
      ELSE greatest(0.01::DOUBLE, least(0.99::DOUBLE, lim.p + sign(sp.p_raw - lim.p)
        * (0.2::DOUBLE + 0.05::DOUBLE * ((sp.ts_event_ms - lim.ts_event_ms) / 1000.0::DOUBLE)))) END
  FROM lim JOIN sp ON sp.match_id = lim.match_id AND sp.pn = lim.pn + 1),
pr AS (
  SELECT sp.*, sp.ts_event_ms AS ts_calc_ms, lim.p AS p_team_a_win, 1 - lim.p AS p_team_b_win,
    'v0.1.0-baseline' AS model_version FROM sp JOIN lim USING (match_id, pn))"""

OUTCOMES = """
oc AS (
  SELECT match_id, arg_max(winner_team, seq_no) AS winner_team, max(ts_event_ms) AS finished_ms
  FROM ev WHERE type = 'match_end' GROUP BY match_id),
jd AS (
  SELECT pr.*, oc.winner_team, oc.finished_ms, CASE WHEN oc.winner_team = 'A' THEN 1 ELSE 0 END AS won_a
  FROM pr JOIN oc USING (match_id))"""

ROUNDS = """
rm AS (
  SELECT match_id, map_id, round_no,
    count(*) FILTER (type = 'kill' AND killer_team = 'A') AS team_a_kills,
    count(*) FILTER (type = 'kill' AND killer_team = 'A' AND is_headshot) AS team_a_headshots,
    count(*) FILTER (type = 'kill' AND killer_team = 'A' AND is_first_kill) AS team_a_first_kills,
    count(*) FILTER (type = 'kill' AND killer_team = 'B') AS team_b_kills,
    count(*) FILTER (type = 'kill' AND killer_team = 'B' AND is_headshot) AS team_b_headshots,
    count(*) FILTER (type = 'kill' AND killer_team = 'B' AND is_first_kill) AS team_b_first_kills,
    coalesce(max(score_a) FILTER (type = 'round_end'), 0) AS team_a_score,
    coalesce(max(score_b) FILTER (type = 'round_end'), 0) AS team_b_score,
    count(*) AS events_count,
    coalesce(arg_max(winner_team, seq_no) FILTER (type = 'round_end'), '') AS round_winner,
    min(ts_event_ms) AS first_event_ms, max(ts_event_ms) AS last_event_ms,
    strftime(epoch_ms(min(ts_event_ms)), '%Y-%m-%d') AS date, max(ts_event_ms) AS version,
    max(ts_event_ms) // 1000 - min(ts_event_ms) // 1000 AS round_duration_sec,
    count(*) FILTER (type = 'match_start') AS starts, count(*) FILTER (type = 'match_end') AS ends,
    coalesce(arg_max(econ_a, seq_no) FILTER (type = 'economy_update'), 0) AS team_a_econ,
    coalesce(arg_max(econ_b, seq_no) FILTER (type = 'economy_update'), 0) AS team_b_econ,
    arg_min(killer_team, seq_no) FILTER (type = 'kill') AS first_blood_team,
    arg_min(killer_player_id, seq_no) FILTER (type = 'kill') AS first_blood_player,
    arg_max(win_reason, seq_no) FILTER (type = 'round_end') AS win_reason,
    arg_max(alive_a, seq_no) FILTER (type = 'round_end') AS team_a_alive,
    arg_max(alive_b, seq_no) FILTER (type = 'round_end') AS team_b_alive
  FROM ev GROUP BY match_id, map_id, round_no)"""

PLAYERS = """
pe AS (
  SELECT match_id, map_id, round_no, killer_player_id AS player_id, killer_team AS team, 1 AS kills, 0 AS deaths,
    CAST(is_headshot AS INT) AS headshots, CAST(is_first_kill AS INT) AS first_kills, 0 AS damage
  FROM ev WHERE type = 'kill'
  UNION ALL
  SELECT match_id, map_id, round_no, victim_player_id, victim_team, 0, 1, 0, 0, 0 FROM ev WHERE type = 'kill'
  UNION ALL
  SELECT match_id, map_id, round_no, killer_player_id, killer_team, 0, 0, 0, 0, damage FROM ev
  WHERE type = 'player_hurt')"""
PLAYER_SUMS = """CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths,
  CAST(sum(headshots) AS BIGINT) AS headshots, CAST(sum(first_kills) AS BIGINT) AS first_kills,
  CAST(sum(damage) AS BIGINT) AS damage_dealt"""

MATCH_METRICS = """
mt AS (
  SELECT match_id, map_id, max(round_no) AS total_rounds,
    coalesce(max(score_a) FILTER (type = 'round_end'), 0) AS team_a_rounds_won,
    coalesce(max(score_b) FILTER (type = 'round_end'), 0) AS team_b_rounds_won,
    count(*) FILTER (type = 'kill') AS total_kills,
    count(*) FILTER (type = 'kill' AND killer_team = 'A') AS team_a_kills,
    count(*) FILTER (type = 'kill' AND killer_team = 'B') AS team_b_kills,
    count(*) FILTER (type = 'kill' AND is_headshot) AS total_headshots, count(*) AS events_count,
    min(ts_event_ms) AS match_start_ms, max(ts_event_ms) AS last_event_ms,
    CASE WHEN count(*) FILTER (type = 'match_end') > 0 THEN 'finished'
      WHEN count(*) FILTER (type = 'match_start') > 0 THEN 'live' ELSE 'unknown' END AS status,
    strftime(epoch_ms(min(ts_event_ms)), '%Y-%m-%d') AS date
  FROM ev GROUP BY match_id, map_id)"""


def sql(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(c.strip() for c in ctes)}\n{body.strip()}"


def ev(body: str, *more: str) -> str:
    return sql(FX, *more, body=body)


def pred(body: str, *more: str) -> str:
    return sql(FX, STATE, FEATURES, PRED, *more, body=body, recursive=True)


ISO = "strftime(epoch_ms({}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
ALL_ERRORS = "concat_ws(',', strict_error, skew_error, payload_error)"
BAD = "strict_error IS NOT NULL OR skew_error IS NOT NULL OR payload_error IS NOT NULL"
ARRIVAL = "arrival_key, event_id, copy_no"
BUCKETS = [50, 100, 200, 300, 400, 500, 750, 1000, 2000]
HISTOGRAM = f"""
le AS (SELECT unnest([{', '.join(f'{b}.0' for b in BUCKETS)}, 'infinity'::DOUBLE]::DOUBLE[]) AS le),
h AS (
  SELECT event_type, le, count(*) FILTER (e2e_ms <= le) AS cumulative, count(*) AS count, sum(e2e_ms) AS sum
  FROM lat, le GROUP BY event_type, le)"""


def errors(column: str) -> str:
    return sql(FX, ARR, WIRE, body=f"SELECT event_id, match_id, CAST(seq_no AS VARCHAR) AS seq_no, "
                                   f"coalesce({column}, '') AS errors FROM wr")


_REQUESTS = """
rq AS (
  SELECT *, event_no // 240 * 3 + CASE WHEN event_no % 240 < 120 THEN 0 WHEN event_no % 240 < 180 THEN 1 ELSE 2 END
    AS request_no FROM wr),
rp AS (
  SELECT *, row_number() OVER (PARTITION BY request_no ORDER BY event_no, copy_no) - 1 AS pos,
    count(*) OVER (PARTITION BY request_no) > 100 AS oversized FROM rq),
rs AS (
  SELECT request_no, pos, event_id, NOT oversized AND strict_error IS NULL AS success,
    CASE WHEN oversized THEN 'BATCH_TOO_LARGE' WHEN strict_error IS NOT NULL THEN 'Validation failed' END AS error,
    row_number() OVER (PARTITION BY match_id, event_id, NOT oversized AND strict_error IS NULL ORDER BY request_no, pos)
      AS seen FROM rp)"""

ORACLE: dict[str, str] = {
    # Sources, sinks, intake
    "raw_append_columns": ev(f"""
        SELECT event_id, match_id, map_id, seq_no, type, source, strftime(epoch_ms(ts_event_ms), '%Y-%m-%d') AS date,
          ts_event_ms // 3600000 * 3600000 AS hour_ms, CAST(strftime(epoch_ms(ts_event_ms), '%Y%m') AS INT) AS month,
          CAST(strftime(epoch_ms(ts_ingest_ms), '%Y%m%d') AS INT) AS ingest_day, ts_event_ms AS version, trace_id
        FROM ev"""),
    "batch_outcomes": sql(FX, ARR, WIRE, body="""
        , pe AS (SELECT event_id, plain_error IS NOT NULL AS bad, count(*) AS n FROM wr GROUP BY ALL)
        SELECT 'processed' AS outcome, count(*) FILTER (NOT bad) AS events FROM pe
        UNION ALL SELECT 'duplicate', CAST(sum(n - 1) FILTER (NOT bad) AS BIGINT) FROM pe
        UNION ALL SELECT 'error', CAST(sum(n) FILTER (bad) AS BIGINT) FROM pe"""),
    "validate_envelope": errors("plain_error"),
    "validate_strict": errors("strict_error"),
    "validate_payload": errors("concat_ws(',', plain_error, payload_error)"),
    "validate_types": errors("""concat_ws(',', plain_error, payload_error, CASE WHEN k = 90 THEN 'round_no'
        WHEN k = 89 THEN 'seq_no' WHEN k = 88 THEN 'trace_id'
        WHEN k = 87 AND type IN ('round_end', 'round_start') THEN 'payload.team_a_score'
        WHEN k = 86 AND type = 'kill' THEN 'payload.is_headshot,payload.is_first_kill'
        WHEN k = 85 AND type = 'economy_update' THEN 'payload.team_b_equipment_value' WHEN k = 84 THEN 'payload'
        WHEN k IN (82, 83) AND type LIKE 'bomb%' THEN 'payload.time_remaining_sec' END)"""),
    "batch_results": sql(FX, ARR, WIRE, _REQUESTS, body="""
        SELECT request_no, pos, event_id, success, success AND seen > 1 AS duplicate, error FROM rs"""),
    "batch_totals": sql(FX, ARR, WIRE, _REQUESTS, body="""
        SELECT request_no, count(*) AS total, count(*) FILTER (success AND seen = 1) AS processed,
          count(*) FILTER (success AND seen > 1) AS duplicates, count(*) FILTER (NOT success) AS errors
        FROM rs GROUP BY request_no"""),
    "clock_skew": errors("concat_ws(',', plain_error, skew_error)"),
    "quarantine_rows": sql(FX, ARR, WIRE, body=f"""
        SELECT event_id, match_id || ':' || map_id AS shard, {ALL_ERRORS} AS error, 0 AS retry_count,
          {ISO.format('ts_ingest_ms')} AS first_failed_at, {ISO.format('ts_ingest_ms')} AS last_failed_at,
          CAST(seq_no AS VARCHAR) AS event_seq_no FROM wr WHERE {BAD}"""),
    "ingestion_errors": sql(FX, ARR, WIRE, body=f"""
        SELECT source, error_code, count(*) AS errors, count(*) FILTER (seq_no % 3 <> 0) AS pending
        FROM (SELECT source, seq_no, unnest(string_split({ALL_ERRORS}, ',')) AS error_code FROM wr WHERE {BAD}) AS z
        GROUP BY source, error_code"""),
    "processing_outcomes": sql(FX, ARR, WIRE, body="""
        , d AS (SELECT source, event_id, plain_error IS NOT NULL AS bad,
            CASE WHEN k = 95 THEN NULL ELSE ts_ingest_ms - ts_event_ms END AS delay FROM wr),
        s AS (SELECT source, CASE WHEN bad THEN 'failed' WHEN row_number() OVER (PARTITION BY source, event_id, bad
            ORDER BY delay) = 1 THEN 'processed' ELSE 'duplicate' END AS status, delay FROM d)
        SELECT source AS processor, status, count(*) AS events, round(avg(delay), 6) AS avg_latency_ms
        FROM s GROUP BY source, status"""),
    "export_match": ev(f"""
        SELECT match_id, seq_no, event_id, map_id, type, {ISO.format('ts_event_ms')} AS ts_event, trace_id FROM ev"""),
    "import_roundtrip": ev("""
        SELECT event_id, match_id, map_id, round_no, type, source, seq_no, ts_event_ms, ts_ingest_ms FROM ev"""),
    "training_dataset": pred("""
        SELECT match_id, map_id, round_no, ts_calc_ms, round(p_team_a_win, 6) AS p_team_a_win,
          CAST(alive_diff AS DOUBLE) AS alive_diff, winner_team AS outcome FROM jd""", OUTCOMES),
    "webhook_outbox": pred("""
        SELECT match_id, state_version, (SELECT count(*) FROM cl WHERE is_active AND has_webhook) AS recipients,
          (SELECT CAST(sum(('0x' || substr(md5(id || ' https://client.example/' || id), 1, 8))::BIGINT) AS BIGINT) FROM cl WHERE is_active AND has_webhook) AS audience FROM pr""", CLIENTS),
    "update_feed": pred(f"""
        SELECT match_id AS key, 'state' AS type, match_id, {ISO.format('ts_event_ms')} AS timestamp, state_version, phase
        FROM st UNION ALL
        SELECT match_id, 'prediction', match_id, {ISO.format('ts_calc_ms')}, state_version, NULL FROM pr"""),
    # Filters
    "events_parsed": ev("""
        SELECT strftime(epoch_ms(ts_event_ms), '%Y-%m-%d') AS date, ts_event_ms, match_id, map_id, round_no, event_id,
          type, CASE WHEN type = 'kill' THEN killer_team ELSE '' END AS killer_team,
          CASE WHEN type = 'kill' THEN victim_team ELSE '' END AS victim_team,
          CASE WHEN type = 'kill' THEN weapon ELSE '' END AS weapon,
          CASE WHEN type = 'round_end' THEN winner_team ELSE '' END AS winner_team,
          CASE WHEN type = 'round_end' THEN win_reason ELSE '' END AS win_reason,
          type = 'kill' AND is_headshot AS is_headshot,
          CASE WHEN type = 'economy_update' THEN econ_a ELSE 0 END AS team_a_econ,
          CASE WHEN type = 'economy_update' THEN econ_b ELSE 0 END AS team_b_econ,
          CASE WHEN type = 'economy_update' THEN equip_a ELSE 0 END AS team_a_equipment_value,
          CASE WHEN type = 'economy_update' THEN equip_b ELSE 0 END AS team_b_equipment_value
        FROM ev WHERE type IN ('kill', 'economy_update', 'round_end')"""),
    "significant_events": ev("""
        SELECT event_id, match_id, seq_no, type FROM ev
        WHERE type IN ('round_start', 'round_end', 'kill', 'bomb_planted', 'bomb_defused', 'bomb_exploded')"""),
    "live_matches_recent": ev("""
        , n AS (SELECT max(ts_event_ms) AS now FROM ev)
        SELECT match_id, map_id, team_a_rounds_won, team_b_rounds_won, total_kills, events_count, match_start_ms,
          last_event_ms, now // 1000 - last_event_ms // 1000 AS seconds_since_last_event
        FROM mt, n WHERE status = 'live' AND last_event_ms > now - 300000""", MATCH_METRICS),
    "retention": sql(LATENCY, body="""
        , d AS (SELECT *, CAST(epoch_ms(ts_ms) AS DATE) AS date FROM lat)
        SELECT event_id, ts_ms FROM d WHERE date >= (SELECT max(date) + 10 FROM d) - 30"""),
    "tier_retention": sql(AUDIT, CLIENTS, body="""
        , d AS (SELECT *, CAST(epoch_ms(ts_ms) AS DATE) AS date FROM aud)
        SELECT request_id, client_id, tier, ts_ms FROM d LEFT JOIN cl ON cl.id = d.client_id
        WHERE tier IS NULL OR date >= (SELECT max(date) FROM d) - CASE tier WHEN 'silver' THEN 7 WHEN 'gold' THEN 30 ELSE 365 END"""),
    "scope_check": sql(AUDIT, CLIENTS, body="""
        SELECT request_id, client_id, action || ':matches' AS needed, CASE client_id % 4 WHEN 0 THEN true
          WHEN 1 THEN action = 'view' WHEN 2 THEN action = 'click' ELSE action IN ('purchase', 'signup') END AS allowed
        FROM aud JOIN cl ON cl.id = client_id"""),
    "ip_allow": sql(AUDIT, CLIENTS, body="""
        SELECT request_id, client_id, ip_address, CASE client_id % 3 WHEN 0 THEN true
          WHEN 1 THEN ip_address LIKE '10.0.1.%' ELSE ip_address IN ('10.0.2.7', '10.0.2.9') END AS allowed
        FROM aud JOIN cl ON cl.id = client_id"""),
    "match_search": sql(MATCHES, body="""
        SELECT id, team_a_id, team_b_id, tournament, scheduled_ms FROM ma
        WHERE status = 'finished' AND (team_a_id = 3 OR team_b_id = 3) AND tournament = 'tournament_1'
          AND scheduled_ms BETWEEN 788918400000 AND 851990400000"""),
    "range_filters": pred("""
        SELECT match_id, state_version, round_no, ts_calc_ms, round(p_team_a_win, 6) AS p_team_a_win FROM pr
        WHERE round_no BETWEEN 2 AND 5"""),
    "events_in_range": ev("""
        SELECT event_id, match_id, seq_no, type, ts_event_ms FROM ev
        WHERE ts_event_ms BETWEEN 1704067800000 AND 1704069000000"""),
    # Joins
    "live_matches": sql(MATCHES, TEAMS, body="""
        SELECT ma.id, format, started_ms, a.name AS team_a_name, b.name AS team_b_name FROM ma
        JOIN teams a ON a.id = team_a_id JOIN teams b ON b.id = team_b_id WHERE status = 'live'"""),
    "match_details": sql(MATCHES, TEAMS, MAPS, body="""
        SELECT ma.id, ma.status, a.name AS team_a_name, b.name AS team_b_name, map_number, map_name, team_a_score,
          team_b_score FROM ma JOIN teams a ON a.id = team_a_id JOIN teams b ON b.id = team_b_id
        LEFT JOIN mm ON mm.match_id = ma.id AND mm.status = 'live'"""),
    "match_document": sql(MATCHES, TEAMS, MAPS, body="""
        SELECT ma.id, a.name AS team_a_name, b.name AS team_b_name, w.name AS winner_name, ma.status,
          CAST(map_number - 1 AS BIGINT) AS pos, map_number, map_name, team_a_score, team_b_score,
          CASE WHEN team_a_score > team_b_score THEN a.name WHEN team_a_score < team_b_score THEN b.name END AS map_winner FROM ma
        JOIN teams a ON a.id = team_a_id JOIN teams b ON b.id = team_b_id LEFT JOIN teams w ON w.id = winner_id
        LEFT JOIN mm ON mm.match_id = ma.id"""),
    "replay_diff": ev("""
        , r AS (SELECT match_id, seq_no, type, round_no, winner_team, event_no FROM ev),
        s AS (SELECT r.*, v.lossy, sum(CASE WHEN type = 'map_start' THEN 1 ELSE 0 END) OVER (PARTITION BY v.lossy,
            match_id ORDER BY seq_no) AS seg FROM r, (SELECT true AS lossy UNION ALL SELECT false) AS v
            WHERE NOT (v.lossy AND event_no % 37 = 0)),
        f AS (SELECT lossy, match_id, seg, max(CASE WHEN type = 'map_start' THEN 1 ELSE round_no END) AS round_no,
            count(*) FILTER (type = 'round_end' AND winner_team = 'A') AS score_a,
            count(*) FILTER (type = 'round_end' AND winner_team = 'B') AS score_b
          FROM s GROUP BY lossy, match_id, seg
          QUALIFY seg = max(seg) OVER (PARTITION BY lossy, match_id)),
        u AS (UNPIVOT (SELECT lossy, match_id, CAST(round_no AS VARCHAR) AS round_no, CAST(score_a AS VARCHAR) AS score_a,
            CAST(score_b AS VARCHAR) AS score_b FROM f) ON round_no, score_a, score_b INTO NAME field VALUE v)
        SELECT match_id, field, l.v AS live, p.v AS replay
        FROM (SELECT * FROM u WHERE NOT lossy) AS l FULL JOIN (SELECT * FROM u WHERE lossy) AS p USING (match_id, field)
        WHERE l.v IS DISTINCT FROM p.v"""),
    "prediction_history_doc": pred(f"""
        , n AS (SELECT *, row_number() OVER (PARTITION BY match_id, map_id ORDER BY state_version) AS i,
            count(*) OVER (PARTITION BY match_id, map_id) AS total_points FROM pr)
        SELECT match_id, map_id, (i - 1) // 10 AS page, {uid('m % 10')} AS team_a_id,
          {uid('(m % 10 + 1 + m % 9) % 10')} AS team_b_id, total_points, (i - 1) % 10 AS pos, ts_calc_ms,
          round(p_team_a_win, 6) AS p_team_a_win, type AS trigger_event_type FROM n"""),
    "match_latest_prediction": pred("""
        , e AS (SELECT match_id, count(*) AS events FROM ev GROUP BY match_id),
        l AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ts_calc_ms DESC,
            state_version DESC) = 1)
        SELECT e.match_id, events, ts_calc_ms, round_no, round(p_team_a_win, 6) AS p_team_a_win
        FROM e LEFT JOIN l USING (match_id)"""),
    "key_audit": sql(AUDIT, CLIENTS, body="""
        , a AS (SELECT request_id, client_id AS c, 'mk_' || lpad(CAST(client_id + CASE WHEN request_id % 7 = 0
            THEN 100000000 ELSE 0 END AS VARCHAR), 8, '0') AS key_prefix FROM aud)
        SELECT request_id, a.key_prefix, cl.id AS client_id,
          coalesce(request_id % 5 <> 0 AND cl.id = c AND is_active, false) AS valid
        FROM a LEFT JOIN cl USING (key_prefix)"""),
    "integrity_missing": sql(FX, ARR, body="""
        SELECT match_id, event_id, min(ts_ingest_ms) AS first_received_ms FROM arr WHERE event_no % 37 = 0
        GROUP BY match_id, event_id"""),
    "integrity_ratio": ev("""
        SELECT match_id, count(*) AS received, count(*) FILTER (event_no % 37 <> 0) AS stored,
          round(count(*) FILTER (event_no % 37 <> 0) / count(*), 6) AS stored_ratio,
          count(*) FILTER (event_no % 37 = 0) = 0 AS checksum_equal
        FROM ev GROUP BY match_id"""),
    "player_leaderboard": ev(f"""
        SELECT match_id, map_id, player_id, team, {PLAYER_SUMS},
          'player_' || CAST(CAST(substr(player_id, 25, 12) AS BIGINT) AS VARCHAR) AS nickname,
          CASE WHEN CAST(substr(player_id, 25, 12) AS BIGINT) % 100 < 10 THEN 'A' ELSE 'B' END AS home_team
        FROM pe GROUP BY match_id, map_id, player_id, team""", PLAYERS),
    # Aggregates
    "match_metrics": ev("SELECT * FROM mt", MATCH_METRICS),
    "player_stats": ev(f"""
        SELECT match_id, map_id, player_id, team, {PLAYER_SUMS} FROM pe
        GROUP BY match_id, map_id, player_id, team""", PLAYERS),
    "player_round_stats": ev(f"""
        SELECT match_id, map_id, round_no, player_id, team, {PLAYER_SUMS} FROM pe
        GROUP BY match_id, map_id, round_no, player_id, team""", PLAYERS),
    "team_round_stats": ev("""
        SELECT match_id, map_id, round_no, team, max(equipment_value) AS equipment_value, max(money) AS money_start FROM (
          SELECT match_id, map_id, round_no, 'A' AS team, equip_a AS equipment_value, econ_a AS money FROM ev
          WHERE type = 'economy_update' UNION ALL
          SELECT match_id, map_id, round_no, 'B', equip_b, econ_b FROM ev WHERE type = 'economy_update') AS z
        GROUP BY match_id, map_id, round_no, team"""),
    "match_timeline": ev("""
        SELECT match_id, ts_event_ms // 60000 * 60000 AS minute_ms, count(*) AS events_count,
          count(*) FILTER (type = 'kill') AS kills_count FROM ev GROUP BY 1, 2"""),
    "event_counts": ev("SELECT match_id, type, count(*) AS events FROM ev GROUP BY match_id, type"),
    "round_view": ev("""
        SELECT match_id, map_id, round_no, team_a_kills, team_b_kills, team_a_headshots, team_b_headshots,
          team_a_score, team_b_score, round_winner, round_duration_sec FROM rm""", ROUNDS),
    "match_summary": ev("""
        SELECT match_id, map_id, count(*) FILTER (round_winner = 'A') AS team_a_rounds,
          count(*) FILTER (round_winner = 'B') AS team_b_rounds, CAST(sum(team_a_kills) AS BIGINT) AS team_a_total_kills,
          CAST(sum(team_b_kills) AS BIGINT) AS team_b_total_kills,
          coalesce(round(sum(team_a_headshots) / nullif(sum(team_a_kills), 0) * 100, 6), 0) AS team_a_hs_percentage,
          coalesce(round(sum(team_b_headshots) / nullif(sum(team_b_kills), 0) * 100, 6), 0) AS team_b_hs_percentage,
          round(avg(round_duration_sec), 6) AS avg_round_duration_sec,
          CASE WHEN sum(ends) > 0 THEN 'finished' WHEN sum(starts) > 0 THEN 'live' ELSE 'unknown' END AS status
        FROM rm GROUP BY match_id, map_id""", ROUNDS),
    "round_enriched": ev("""
        SELECT match_id, map_id, round_no, round_winner, team_a_econ, team_b_econ,
          coalesce(first_blood_team, '') AS first_blood_team,
          round(sum(CASE round_winner WHEN 'A' THEN 1 WHEN 'B' THEN -1 ELSE 0 END) OVER (PARTITION BY match_id, map_id
            ORDER BY round_no RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) / 5, 6) AS momentum,
          round(greatest(-1, least(1, (team_a_econ - team_b_econ) / 10000)), 6) AS economy_pressure,
          CASE WHEN round_no <= 12 THEN '1' WHEN round_no <= 24 THEN '2' ELSE 'overtime' END AS current_half
        FROM rm""", ROUNDS),
    "win_streaks": ev("""
        , g AS (SELECT *, count(*) FILTER (round_winner = 'A') OVER w AS a, count(*) FILTER (round_winner = 'B') OVER w AS b
          FROM rm WINDOW w AS (PARTITION BY match_id, map_id ORDER BY round_no)),
        s AS (SELECT *, a - min(a) OVER (PARTITION BY match_id, map_id, b ORDER BY round_no) AS sa_,
            b - min(b) OVER (PARTITION BY match_id, map_id, a ORDER BY round_no) AS sb_,
            first_value(round_winner) OVER (PARTITION BY match_id, map_id, b ORDER BY round_no) AS fa,
            first_value(round_winner) OVER (PARTITION BY match_id, map_id, a ORDER BY round_no) AS fb FROM g),
        z AS (SELECT *, sa_ + CASE WHEN fa = 'A' AND b = 0 THEN 1 ELSE 0 END AS sa,
            sb_ + CASE WHEN fb = 'B' AND a = 0 THEN 1 ELSE 0 END AS sb FROM s)
        SELECT match_id, map_id, round_no, round_winner, CASE WHEN sa > 0 THEN 'A' WHEN sb > 0 THEN 'B' ELSE 'none' END
          AS streak_team, greatest(sa, sb) AS streak_length FROM z""", ROUNDS),
    "round_report": ev("""
        SELECT match_id, map_id, round_no, round_winner AS winner_team, win_reason, team_a_kills, team_b_kills,
          team_a_alive, team_b_alive, first_blood_player, first_blood_team, round_duration_sec FROM rm""", ROUNDS),
    "team_match_stats": ev("""
        , e AS (
          SELECT match_id, killer_team AS team, 0 AS r, 0 AS w, 1 AS k, 0 AS d, CAST(is_headshot AS INT) AS h,
            CAST(is_first_kill AS INT) AS f, 0 AS c, 0 AS cn, 0 AS dm FROM ev WHERE type = 'kill'
          UNION ALL SELECT match_id, victim_team, 0, 0, 0, 1, 0, 0, 0, 0, 0 FROM ev WHERE type = 'kill'
          UNION ALL SELECT match_id, 'A', 1, CAST(winner_team = 'A' AS INT), 0, 0, 0, 0, 0, 0, 0 FROM ev WHERE type = 'round_end'
          UNION ALL SELECT match_id, 'B', 1, CAST(winner_team = 'B' AS INT), 0, 0, 0, 0, 0, 0, 0 FROM ev WHERE type = 'round_end'
          UNION ALL SELECT match_id, 'A', 0, 0, 0, 0, 0, 0, econ_a, 1, 0 FROM ev WHERE type = 'economy_update'
          UNION ALL SELECT match_id, 'B', 0, 0, 0, 0, 0, 0, econ_b, 1, 0 FROM ev WHERE type = 'economy_update'
          UNION ALL SELECT match_id, killer_team, 0, 0, 0, 0, 0, 0, 0, 0, damage FROM ev WHERE type = 'player_hurt')
        SELECT match_id, team, CAST(sum(w) AS BIGINT) AS rounds_won, CAST(sum(k) AS BIGINT) AS kills,
          CAST(sum(d) AS BIGINT) AS deaths, coalesce(round(sum(h) / nullif(sum(k), 0) * 100, 6), 0) AS headshot_percentage,
          coalesce(round(sum(f) / nullif(sum(r), 0), 6), 0) AS first_kill_rate,
          coalesce(round(sum(c) / nullif(sum(cn), 0), 6), 0) AS avg_economy,
          coalesce(round(sum(dm) / nullif(sum(r), 0), 6), 0) AS damage_per_round
        FROM e GROUP BY match_id, team"""),
    "weapon_stats": ev("""
        SELECT weapon, count(*) AS kills, count(*) FILTER (is_headshot) AS headshots FROM ev WHERE type = 'kill'
        GROUP BY weapon"""),
    "brier": pred("""
        SELECT round(avg((p_team_a_win - won_a) * (p_team_a_win - won_a)), 6) AS brier_score, count(*) AS predictions
        FROM jd""", OUTCOMES),
    "calibration": pred("""
        SELECT CAST(least(floor(p_team_a_win * 10), 9) AS INT) AS bin, round(avg(p_team_a_win), 6) AS avg_probability,
          round(avg(won_a), 6) AS win_rate, count(*) AS predictions FROM jd GROUP BY 1""", OUTCOMES),
    "model_quality": pred("""
        , h AS (SELECT *, CASE WHEN (p_team_a_win > 0.5) = (won_a = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM jd),
        g AS (SELECT model_version, 'rules ' || model_version AS model_name, avg(hit) AS accuracy,
            avg(-ln(CASE WHEN won_a = 1 THEN p_team_a_win ELSE 1 - p_team_a_win END)) AS log_loss,
            avg((p_team_a_win - won_a) * (p_team_a_win - won_a)) AS brier_score,
            avg(hit) FILTER (finished_ms > (SELECT max(ts_event_ms) FROM ev) - 86400000) AS recent_accuracy,
            count(*) AS predictions FROM h GROUP BY model_version)
        SELECT model_version, model_name, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss,
          round(brier_score, 6) AS brier_score, round(recent_accuracy, 6) AS recent_accuracy, predictions,
          coalesce(recent_accuracy < 0.6, false) AS drift_alarm FROM g""", OUTCOMES),
    "match_status_counts": sql(MATCHES, body="SELECT status, count(*) AS matches FROM ma GROUP BY status"),
    "latest_prediction": pred("""
        SELECT match_id, map_id, ts_calc_ms, state_version, round(p_team_a_win, 6) AS p_team_a_win,
          round(p_team_b_win, 6) AS p_team_b_win FROM pr
        QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ts_calc_ms DESC, state_version DESC) = 1"""),
    "dlq_stats": sql(FX, ARR, WIRE, body=f"""
        SELECT shard, count(*) AS entries FROM (SELECT match_id || ':' || map_id AS shard FROM wr WHERE {BAD}) AS z
        GROUP BY ROLLUP (shard)"""),
    "dlq_entries": sql(FX, ARR, WIRE, body=f"""
        , q AS (SELECT match_id || ':' || map_id AS shard, event_id, min(ts_ingest_ms) AS failed_at FROM wr WHERE {BAD}
          GROUP BY ALL)
        SELECT shard, event_id, row_number() OVER (PARTITION BY shard ORDER BY failed_at, event_id) AS place FROM q
        QUALIFY place <= 3"""),
    "retry_exhausted": ev("""
        SELECT event_id, match_id || ':' || map_id AS shard, CAST(k % 6 AS BIGINT) AS retry_count,
          ts_ingest_ms + 1 AS first_failed_at, ts_ingest_ms + 1 AS last_failed_at FROM ev WHERE k % 6 >= 3"""),
    "requeue": ev("SELECT event_id, match_id, seq_no, event_no % 11 = 0 AS requeued FROM ev"),
    # Windows and sequences
    "dedup_first": sql(FX, ARR, body="""
        SELECT event_id, match_id, seq_no, copy_no, version FROM arr
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_key, copy_no) = 1"""),
    "dedup_latest": sql(FX, ARR, body="""
        SELECT event_id, match_id, map_id, round_no, ts_event_ms, version, copy_no FROM arr
        QUALIFY row_number() OVER (PARTITION BY match_id, map_id, round_no, ts_event_ms, event_id
          ORDER BY version DESC, ts_ingest_ms DESC, copy_no DESC) = 1"""),
    "sequence_gaps": sql(FX, ARR, body=f"""
        SELECT match_id, map_id, event_id, copy_no, seq_no,
          seq_no - lag(seq_no) OVER (PARTITION BY match_id, map_id ORDER BY {ARRIVAL}) - 1 AS gap FROM arr"""),
    "late_events": sql(FX, ARR, body=f"""
        , s AS (SELECT *, max(seq_no) OVER (PARTITION BY match_id, map_id ORDER BY {ARRIVAL}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arr)
        SELECT match_id, map_id, event_id, copy_no, seq_no, ts_ingest_ms - ts_event_ms AS age_ms,
          CASE WHEN ts_ingest_ms - ts_event_ms <= 2000 THEN 'reprocess' ELSE 'drop' END AS action
        FROM s WHERE seq_no <= top"""),
    "match_state": ev(f"SELECT {STATE_OUT} FROM st", STATE),
    "replay_final_state": ev(f"""
        SELECT {STATE_OUT} FROM st
        QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY state_version DESC) = 1""", STATE),
    "monotone_updates": sql(FX, ARR, body=f"""
        , s AS (SELECT *, max(seq_no) OVER (PARTITION BY match_id ORDER BY {ARRIVAL}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arr)
        SELECT match_id, seq_no AS state_version, copy_no FROM s WHERE top IS NULL OR seq_no > top"""),
    "swing_flags": pred("""
        , l AS (SELECT *, (ts_calc_ms - lag(ts_calc_ms) OVER w) / 1000.0::DOUBLE AS dt,
            p_team_a_win - lag(p_team_a_win) OVER w AS mv FROM pr WINDOW w AS (PARTITION BY match_id ORDER BY state_version))
        SELECT match_id, state_version, round(dt, 6) AS dt_seconds, round(mv, 6) AS p_move,
          coalesce(dt > 0 AND abs(mv) > dt * 0.2::DOUBLE + 0.05::DOUBLE, false) AS is_jump FROM l"""),
    "effective_flags": sql(AUDIT, body="""
        , c AS (SELECT request_id, client_id, 'NATION_' || CAST((client_id * 7 + request_id) % 27 AS VARCHAR) AS name
          FROM aud)
        SELECT request_id, client_id, name, coalesce(CASE WHEN n_nationkey % 3 = 0 AND client_id = n_nationkey + 1
            THEN n_nationkey % 2 = 1 ELSE n_nationkey % 2 = 0 END, false) AS is_enabled
        FROM c LEFT JOIN nation ON n_name = name"""),
    "trim_shard": ev("""
        SELECT match_id, map_id, seq_no, event_id FROM ev
        QUALIFY row_number() OVER (PARTITION BY match_id, map_id ORDER BY seq_no DESC) <= 20"""),
    "queue_lag": ev("SELECT event_id, ts_ingest_ms - ts_event_ms AS lag_ms FROM ev"),
    "shard_backlog": ev("""
        SELECT match_id, map_id, count(*) AS backlog, max(ts_ingest_ms) AS newest_ms,
          (SELECT max(ts_ingest_ms) FROM ev) - max(ts_ingest_ms) AS behind_ms FROM ev GROUP BY match_id, map_id"""),
    # Lists and pages
    "match_page": sql(MATCHES, body="""
        , n AS (SELECT *, row_number() OVER (ORDER BY coalesce(started_ms, scheduled_ms) DESC, id) AS place,
            count(*) OVER () AS total FROM ma)
        SELECT id, status, place, base64(encode(CAST(place AS VARCHAR))) AS cursor, total, total > 60 AS has_next_page
        FROM n WHERE place BETWEEN 41 AND 60"""),
    "teams_by_rating": sql(TEAMS, body="SELECT id, name, rating FROM teams ORDER BY rating DESC, id LIMIT 20 OFFSET 5"),
    "prediction_history": pred("""
        SELECT match_id, map_id, state_version, ts_calc_ms, round_no, round(p_team_a_win, 6) AS p_team_a_win,
          round(p_team_b_win, 6) AS p_team_b_win, round(confidence, 6) AS confidence, type AS trigger_event_type
        FROM pr"""),
    "prediction_latest_n": pred("""
        SELECT match_id, state_version, ts_calc_ms, round(p_team_a_win, 6) AS p_team_a_win,
          row_number() OVER (PARTITION BY match_id ORDER BY ts_calc_ms DESC, state_version DESC) AS place FROM pr
        QUALIFY place <= 5"""),
    "last_events": ev("""
        SELECT match_id, event_id, seq_no, type,
          row_number() OVER (PARTITION BY match_id ORDER BY ts_event_ms DESC, seq_no DESC) AS place FROM ev
        QUALIFY place <= 20"""),
    "audit_recent": sql(AUDIT, body="""
        SELECT client_id, request_id, ts_ms, action,
          row_number() OVER (PARTITION BY client_id ORDER BY ts_ms DESC, request_id DESC) AS place FROM aud
        QUALIFY place <= 10"""),
    # Predictions
    "features": ev("""
        SELECT match_id, state_version, round(econ_diff, 6) AS econ_diff, round(equip_diff, 6) AS equip_diff, round_no,
          a_score AS team_a_score, b_score AS team_b_score, alive_diff, bomb_planted, win_streak_a, win_streak_b,
          round(strength_diff, 6) AS strength_diff FROM ft""", STATE, FEATURES),
    "rule_prediction": ev("""
        SELECT match_id, state_version, round(p_raw, 6) AS p_raw, round(confidence, 6) AS confidence,
          'v0.1.0-baseline' AS model_version FROM sc""", STATE, FEATURES),
    "limited_prediction": pred(f"""
        SELECT match_id, map_id, state_version, round_no, round(p_raw, 6) AS p_raw, round(p_team_a_win, 6) AS p_team_a_win,
          round(p_team_b_win, 6) AS p_team_b_win, round(confidence, 6) AS confidence, p_team_a_win <> p_raw AS limited,
          round(1 / (p_team_a_win * 1.06::DOUBLE), 3) AS odds_a, round(1 / (p_team_b_win * 1.06::DOUBLE), 3) AS odds_b,
          type AS trigger_event_type, {uid('m % 10')} AS team_a_id, {uid('(m % 10 + 1 + m % 9) % 10')} AS team_b_id
        FROM pr"""),
    "scalar_functions": """
        WITH s AS (SELECT CAST(event_id AS BIGINT) AS event_id, value, event_type, floor(value * 4) / 8 + 1.125 AS d
          FROM events)
        SELECT event_id, round(CASE WHEN event_id % 50 = 0 THEN 0.5 ELSE greatest(0.01, least(0.99, value / 560)) END, 6)
            AS safe_p,
          round(1 / (greatest(0.01, least(0.99, value / 560)) * 1.05::DOUBLE), 3) AS decimal_odds,
          CAST(floor(CASE WHEN d >= 2 THEN (d - 1) * 100 ELSE -100 / (d - 1) END + 0.5) AS BIGINT) AS american_odds,
          base64(encode(CAST(event_id AS VARCHAR))) AS cursor, event_id AS cursor_offset, sha256(event_type) AS sha,
          upper(event_type) AS upper_type,
          CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS score_text,
          CASE WHEN value <= 300 THEN 'healthy' WHEN value <= 500 THEN 'warning' ELSE 'critical' END AS latency_status,
          CASE WHEN value / 1000 <= 0.05 THEN 'healthy' WHEN value / 1000 <= 0.1 THEN 'warning' ELSE 'critical' END
            AS error_status FROM s""",
    # Objectives and usage
    "stage_latency": sql(LATENCY, body="""
        SELECT stage, round(quantile_cont(ms, 0.95), 6) AS p95_ms FROM (
          SELECT 'ingest' AS stage, ingest_ms AS ms FROM lat UNION ALL SELECT 'queue', queue_ms FROM lat
          UNION ALL SELECT 'state', state_ms FROM lat UNION ALL SELECT 'predict', predict_ms FROM lat) AS z
        GROUP BY stage"""),
    "slo_status": sql(LATENCY, body="""
        , g AS (SELECT ts_ms // 300000 * 300000 AS bucket_ms, count(*) AS events,
            count(*) FILTER (e2e_ms <= 500) / count(*) * 100 AS c, quantile_cont(e2e_ms, 0.95) AS p FROM lat GROUP BY 1)
        SELECT bucket_ms, events, round(c, 6) AS compliance_percent, round(p, 6) AS p95_ms,
          CASE WHEN p <= 300 THEN 'healthy' WHEN p <= 500 THEN 'warning' ELSE 'critical' END AS status FROM g"""),
    "latency_histogram": sql(LATENCY, HISTOGRAM, body="""
        SELECT event_type, CASE WHEN le = 'infinity' THEN -1 ELSE le END AS le, cumulative, count, round(sum, 3) AS sum
        FROM h"""),
    "histogram_quantile": sql(LATENCY, HISTOGRAM, body="""
        , s AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS before,
            count * 0.95::DOUBLE AS rank FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
        SELECT event_type, round(CASE WHEN le = 'infinity' THEN low
          ELSE low + (le - low) * (rank - before) / (cumulative - before) END, 6) AS quantile
        FROM s WHERE cumulative >= rank AND before < rank"""),
    "error_rate": sql(AUDIT, body="""
        , g AS (SELECT ts_ms // 300000 * 300000 AS bucket_ms, count(*) AS requests,
            count(*) FILTER (status_code >= 500) AS errors FROM aud GROUP BY 1)
        SELECT *, round(errors / requests * 100, 6) AS error_percent,
          CASE WHEN errors / requests * 100 <= 0.05 THEN 'healthy' WHEN errors / requests * 100 <= 0.1 THEN 'warning'
            ELSE 'critical' END AS status FROM g"""),
    "error_budget": sql(AUDIT, body="""
        , g AS (SELECT 'gateway' AS service, ts_ms // 3600000 AS hour, count(*) AS requests,
            count(*) FILTER (status_code >= 500) AS errors FROM aud GROUP BY 1, 2),
        s AS (SELECT *, sum(requests) OVER w * (1 - 0.999::DOUBLE) AS allowed, sum(errors) OVER w AS used,
            sum(errors) OVER (PARTITION BY service ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS used_day
          FROM g WINDOW w AS (PARTITION BY service ORDER BY hour RANGE BETWEEN 671 PRECEDING AND CURRENT ROW))
        SELECT service, hour * 3600000 AS hour_ms, requests, errors, round(allowed, 6) AS allowed_errors,
          round(used / allowed, 6) AS consumed, errors / allowed > 0.02 AS fast_burn, used_day / allowed > 0.05 AS slow_burn
        FROM s"""),
    "throughput": ev("""
        SELECT ts_event_ms // 60000 * 60000 AS bucket_ms, type, count(*) AS events, round(count(*) / 60, 6) AS per_second
        FROM ev GROUP BY 1, 2"""),
    "prediction_throughput": pred("""
        SELECT ts_calc_ms // 60000 * 60000 AS bucket_ms, model_version, count(*) AS events FROM pr GROUP BY 1, 2"""),
    "rate_limited_clients": sql(AUDIT, body="""
        SELECT client_id, count(*) AS rate_limited FROM aud WHERE status_code = 429 GROUP BY client_id"""),
    "quota_usage": sql(AUDIT, CLIENTS, body="""
        , u AS (SELECT client_id, CAST(strftime(epoch_ms(ts_ms), '%Y%m') AS INT) AS month, count(*) AS used FROM aud
          GROUP BY 1, 2),
        q AS (SELECT u.*, tier, CAST(coalesce(quota_monthly, CASE tier WHEN 'silver' THEN 10000000
            WHEN 'gold' THEN 100000000 END) AS BIGINT) AS quota FROM u JOIN cl ON cl.id = client_id)
        SELECT client_id, month, tier, used, quota, round(used / quota, 6) AS share FROM q"""),
    "api_usage": sql(AUDIT, body="""
        SELECT client_id, action, count(*) AS calls, count(*) FILTER (status_code < 400) AS ok,
          count(*) FILTER (status_code BETWEEN 400 AND 499) AS client_errors,
          count(*) FILTER (status_code >= 500) AS server_errors, round(avg(latency_ms), 6) AS avg_ms,
          round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms
        FROM aud GROUP BY client_id, action"""),
    "replay_cursors": ev("""
        SELECT match_id, source, max(seq_no) AS last_seq_no, arg_max(ts_event_ms, seq_no) AS last_event_ms FROM ev
        GROUP BY match_id, source"""),
    "system_summary": pred("""
        SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM pr) AS predictions,
          (SELECT count(*) FROM ma WHERE status = 'live') AS active_matches,
          (SELECT round(avg(e2e_ms), 6) FROM lat) AS avg_latency_ms,
          (SELECT round(count(*) FILTER (status_code >= 500) / count(*), 6) FROM aud) AS error_rate""",
                            MATCHES, LATENCY, AUDIT),
}

_ROUND_OUT = """SELECT match_id, map_id, round_no, team_a_kills, team_a_headshots, team_a_first_kills, team_a_score,
  team_b_kills, team_b_headshots, team_b_first_kills, team_b_score, events_count, round_winner, first_event_ms,
  last_event_ms, date, version FROM rm"""
ORACLE["round_metrics"] = ORACLE["round_metrics_merged"] = ev(_ROUND_OUT, ROUNDS)

for _name, _width in (("latency_slo", 3_600_000), ("latency_slo_minute", 60_000)):
    ORACLE[_name] = sql(LATENCY, body=f"""
        SELECT ts_ms // {_width} * {_width} AS bucket_ms, count(*) AS total_events,
          count(*) FILTER (e2e_ms <= 500) AS met_slo, round(count(*) FILTER (e2e_ms <= 500) / count(*) * 100, 6)
            AS slo_percentage, round(quantile_cont(e2e_ms, 0.5), 6) AS p50_ms, round(quantile_cont(e2e_ms, 0.95), 6)
            AS p95_ms, round(quantile_cont(e2e_ms, 0.99), 6) AS p99_ms, round(max(e2e_ms), 6) AS max_ms
        FROM lat GROUP BY 1""")
_BAND_AT = "max(CASE WHEN {0} >= before AND {0} < before + n THEN low + (high - low) / greatest(n - 1, 1) * ({0} - before) END)"
_SKETCH_Q = ", ".join(
    "round({lo} + ({hi} - {lo}) * max((size - 1) * {q}::DOUBLE - floor((size - 1) * {q}::DOUBLE)), 6) AS {name}".format(
        name=name, q=q, lo=_BAND_AT.format(f"floor((size - 1) * {q}::DOUBLE)"),
        hi=_BAND_AT.format(f"ceil((size - 1) * {q}::DOUBLE)"))
    for name, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)))
ORACLE["latency_sketch"] = sql(LATENCY, body=f"""
        , bd AS (SELECT ts_ms // 3600000 * 3600000 AS bucket_ms, CAST(floor(ln(abs(e2e_ms) + 1) / ln(2) * 32
            * sign(e2e_ms)) AS BIGINT) AS band, count(*) AS n, min(e2e_ms) AS low, max(e2e_ms) AS high FROM lat GROUP BY 1, 2),
        pl AS (SELECT *, sum(n) OVER w - n AS before, sum(n) OVER (PARTITION BY bucket_ms) AS size FROM bd
          WINDOW w AS (PARTITION BY bucket_ms ORDER BY band))
        SELECT bucket_ms, {_SKETCH_Q} FROM pl GROUP BY bucket_ms""")
for _name, _width in (("sliding_rate", 3_600_000), ("sliding_rate_minute", 60_000)):
    ORACLE[_name] = sql(AUDIT, body=f"""
        SELECT request_id, client_id, ts_ms, count(*) OVER (PARTITION BY client_id ORDER BY ts_ms
          RANGE BETWEEN {_width - 1} PRECEDING AND CURRENT ROW) AS requests_in_window FROM aud""")

_SIDES = """
        , z AS (SELECT id, finished_ms, winner_id, team_a_id AS team_id, team_b_id AS opponent_id FROM ma
            WHERE status = 'finished' UNION ALL
          SELECT id, finished_ms, winner_id, team_b_id, team_a_id FROM ma WHERE status = 'finished'),
        r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY finished_ms DESC, id DESC) AS place FROM z
          QUALIFY place <= 10)"""
ORACLE["recent_matches"] = sql(MATCHES, body=f"""{_SIDES}
        SELECT team_id, id, opponent_id, winner_id, finished_ms, place FROM r""")
ORACLE["team_form"] = sql(MATCHES, body=f"""{_SIDES}
        SELECT team_id, count(*) AS played, count(*) FILTER (winner_id = team_id) AS wins,
          count(*) - count(*) FILTER (winner_id = team_id) AS losses,
          round(count(*) FILTER (winner_id = team_id) / count(*), 6) AS win_rate FROM r GROUP BY team_id""")


def _runs(ctes: str, condition: str, service: str, at_least: int) -> str:
    return sql(ctes, body=f"""
        , h AS (SELECT ts_ms // 3600000 AS step FROM {'aud' if 'aud' in ctes else 'lat'} GROUP BY 1 HAVING {condition}),
        i AS (SELECT step, step - row_number() OVER (ORDER BY step) AS island FROM h)
        SELECT '{service}' AS service, min(step) AS run_start, count(*) AS run_length FROM i GROUP BY island
        HAVING count(*) >= {at_least}""")


ORACLE["alert_runs"] = _runs(AUDIT, "count(*) FILTER (status_code >= 500) / count(*) * 100 > 1", "gateway", 2)
ORACLE["latency_alert_runs"] = _runs(LATENCY, "quantile_cont(e2e_ms, 0.95) > 500", "pipeline", 5)

ORACLE["retry_counters"] = f"""
    WITH RECURSIVE fl AS (
      SELECT {uid('user_id')} AS event_id, 'shard-' || CAST(user_id % 16 AS VARCHAR) AS shard,
        1704067200000 + (epoch_us(ts) - 1704067200000000) // 120000 AS failed_at, CAST(event_id AS BIGINT) AS failure_no
      FROM events WHERE event_type = 'error'),
    nf AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY failed_at, failure_no) AS i FROM fl),
    rt AS (
      SELECT *, CAST(1 AS BIGINT) AS tries, failed_at AS first_failed_at FROM nf WHERE i = 1
      UNION ALL
      SELECT n.*, CASE WHEN p.tries = 3 OR n.failed_at >= p.first_failed_at + 3600000 THEN 1 ELSE p.tries + 1 END,
        CASE WHEN p.tries = 3 OR n.failed_at >= p.first_failed_at + 3600000 THEN n.failed_at ELSE p.first_failed_at END
      FROM rt AS p JOIN nf AS n ON n.event_id = p.event_id AND n.i = p.i + 1)
    SELECT event_id, shard, failed_at, failure_no, tries, first_failed_at, tries = 3 AS dead FROM rt"""

_SCRAPES = """
tel AS (
  SELECT 'service_' || CAST(user_id % 3 AS VARCHAR) AS service, CAST(CAST(props->>'k' AS INT) % 2 AS BIGINT) AS instance,
    CAST(props->>'k' AS INT) AS k, event_type = 'error' AS error, value * 5.0 AS ms,
    (epoch_us(ts) - 1704067200000000) // 7200000000 AS step FROM events),
cs AS (
  SELECT metric, label, service, instance, step, sum(n) OVER (PARTITION BY metric, label, service, instance,
    (step + instance * 37) // 90 ORDER BY step) AS value
  FROM (SELECT metric, label, service, instance, step, count(*) FILTER (CASE WHEN metric = 'duration' THEN
      ms <= CAST(label AS DOUBLE) WHEN metric = 'ingest_errors' THEN k = 99 WHEN label = '200' THEN NOT error
      WHEN label = '500' THEN error AND k < 50 ELSE error AND k >= 50 END) AS n
    FROM tel CROSS JOIN (SELECT 'requests' AS metric, unnest(['200', '500', '429']) AS label
      UNION ALL SELECT 'ingest_errors', 'auth_invalid_signature' UNION ALL SELECT 'duration',
        unnest(['50', '100', '200', '300', '400', '500', '750', '1000', '2000', 'Infinity'])) AS l GROUP BY ALL) AS z),
gr AS (
  SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE value - coalesce(lag(value) OVER w, 0) END AS grown
  FROM cs WINDOW w AS (PARTITION BY metric, label, service, instance ORDER BY step)),
fin AS (SELECT max(step) AS until FROM cs),
five AS (
  SELECT * FROM (SELECT metric, label, service, unnest(range(step, step + 5)) AS step, grown FROM gr)
  WHERE step <= (SELECT until FROM fin)),
hb AS (
  SELECT service, step, CAST(label AS DOUBLE) AS le, sum(grown) AS n FROM five WHERE metric = 'duration' GROUP BY ALL),
hc AS (
  SELECT service, step, le, max(n) OVER (PARTITION BY service, step ORDER BY le) AS cumulative,
    max(n) OVER (PARTITION BY service, step) AS count FROM hb),
hs AS (
  SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS before,
    count * 0.95::DOUBLE AS rank FROM hc WINDOW w AS (PARTITION BY service, step ORDER BY le)),
lg AS (
  SELECT service, instance, step, sum(sum(n)) OVER (PARTITION BY service, instance ORDER BY step) AS value
  FROM (SELECT service, instance, step, 1 AS n FROM tel UNION ALL SELECT service, instance, step + k % 4, -1 FROM tel) AS z
  GROUP BY service, instance, step),
lh AS (
  SELECT service, instance, value, unnest(range(step, least(coalesce(lead(step) OVER (PARTITION BY service, instance
    ORDER BY step), (SELECT until + 1 FROM fin)), step + 5, (SELECT until + 1 FROM fin)))) AS step FROM lg),
av AS (
  SELECT 'high_error_rate' AS rule, service, step, sum(grown) FILTER (label LIKE '5%') / sum(grown) AS value
    FROM five WHERE metric = 'requests' GROUP BY service, step
  UNION ALL SELECT 'high_latency_p95', service, step, CASE WHEN le = 'infinity' THEN low
    ELSE low + (le - low) * (rank - before) / (cumulative - before) END FROM hs WHERE cumulative >= rank AND before < rank
  UNION ALL SELECT 'consumer_lag', service, step, CAST(sum(value) AS DOUBLE) FROM lh GROUP BY service, step
  UNION ALL SELECT CASE metric WHEN 'requests' THEN 'rate_limit_spike' ELSE 'invalid_signatures' END, service, step,
    sum(grown) / 60 FROM gr WHERE label IN ('429', 'auth_invalid_signature') GROUP BY metric, service, step),
ru AS (SELECT * FROM (VALUES ('high_error_rate', 'warning', 0.01::DOUBLE, 2), ('high_latency_p95', 'warning', 500, 5),
  ('consumer_lag', 'critical', 4, 1), ('rate_limit_spike', 'warning', 0.02::DOUBLE, 1),
  ('invalid_signatures', 'warning', 0.01::DOUBLE, 1)) AS v(rule, severity, above, hold))"""
ORACLE["alert_values"] = sql(_SCRAPES, body="""
        SELECT rule, service, CAST(step AS BIGINT) AS step, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) AS value FROM av""")
ORACLE["alert_rules"] = sql(_SCRAPES, body="""
        , i AS (SELECT rule, severity, service, step, value, hold, step - row_number() OVER (PARTITION BY rule, service
            ORDER BY step) AS run FROM av JOIN ru USING (rule) WHERE value > above AND NOT isnan(value)),
        g AS (SELECT rule, severity, service, hold, min(step) AS s, max(step) AS e, max(value) AS peak FROM i
          GROUP BY rule, severity, service, hold, run)
        SELECT rule, severity, service, CAST(s AS BIGINT) AS pending_from, CASE WHEN s + hold <= e THEN CAST(s + hold AS BIGINT)
          END AS firing_from, CAST(e AS BIGINT) AS last_step, round(peak, 6) AS peak FROM g""")

# Streams end with what the batch operators give.
ORACLE["stream_state"] = ORACLE["match_state"]
ORACLE["stream_timeline"] = ORACLE["match_timeline"]
ORACLE["stream_round_metrics"] = ORACLE["round_metrics"]
ORACLE["prediction_stream"] = ORACLE["limited_prediction"]
_AMERICAN = "CAST(floor(CASE WHEN {0} = 1 THEN NULL WHEN {0} >= 2 THEN ({0} - 1) * 100 ELSE -100 / ({0} - 1) END + 0.5) AS BIGINT)"
ORACLE["stream_prediction_table"] = pred(f"""
    , o AS (SELECT *, round(1 / (p_team_a_win * 1.06::DOUBLE), 3) AS oa, round(1 / (p_team_b_win * 1.06::DOUBLE), 3) AS ob
      FROM pr)
    SELECT match_id, event_id AS trigger_event_id, ts_calc_ms, model_version,
      CAST(strftime(epoch_ms(ts_calc_ms), '%Y%m') AS INT) AS month, CAST(alive_diff AS DOUBLE) AS part_alive_diff,
      round(equip_diff, 6) AS part_equip_diff, CASE WHEN bomb_planted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS part_bomb,
      oa AS part_odds_a, ob AS part_odds_b, {_AMERICAN.format('oa')} AS american_a, {_AMERICAN.format('ob')} AS american_b
    FROM o""")
ORACLE["stream_update_feed"] = pred(f"""
    , ls AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY state_version DESC) = 1),
    lp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY state_version DESC) = 1)
    SELECT match_id, 'state' AS kind, state_version, round_no, phase, a_score AS score_a, b_score AS score_b,
      {uid('m % 10')} AS team_a_id, CAST(NULL AS DOUBLE) AS p_team_a_win FROM ls
    UNION ALL SELECT match_id, 'prediction', state_version, round_no, NULL, NULL, NULL, NULL, round(p_team_a_win, 6)
    FROM lp""")
# The line of sequence number 7 is no JSON, whatever the event in it.
_VALID = f"(NOT ({BAD})) AND seq_no <> 7"
ORACLE["intake_stream"] = sql(FX, ARR, WIRE, body=f"""
    SELECT DISTINCT event_id, match_id, map_id, round_no, type, source, seq_no, ts_event_ms FROM wr WHERE {_VALID}""")
ORACLE["stream_dedup"] = sql(FX, ARR, WIRE, body=f"""
    SELECT DISTINCT match_id, event_id, CAST(1 AS BIGINT) AS copies FROM wr WHERE {_VALID}""")
_NO_JSON = "event_id,match_id,map_id,round_no,ts_event,type,source,seq_no,payload,clock_skew"
ORACLE["stream_quarantine"] = sql(FX, ARR, WIRE, body=f"""
    SELECT event_id, match_id || ':' || map_id AS shard, {ALL_ERRORS} AS error,
      {ISO.format('ts_ingest_ms')} AS first_failed_at FROM wr WHERE ({BAD}) AND seq_no <> 7
    UNION ALL SELECT NULL, '', '{_NO_JSON}', NULL FROM wr WHERE seq_no = 7""")

# Arrival by arrival: last number and waiting events of a shard, settled events of each step.
_W = "STRUCT(seq BIGINT, since BIGINT, id VARCHAR)[]"


def _settled(arrivals: str) -> str:
    """Steps over ``od`` (match_id, map_id, event_id, seq_no, age, n, clock), and all outcomes."""
    return f"""
od AS ({arrivals}),
sq AS (
  SELECT match_id, map_id, n, seq_no AS last, CAST([] AS {_W}) AS waiting,
    [{{'id': event_id, 'action': 'process', 'outcome': 'in_order', 'since': clock}}] AS settled FROM od WHERE n = 1
  UNION ALL
  SELECT match_id, map_id, n,
    CASE what WHEN 'go' THEN seq_no + len(freed) ELSE last END,
    CASE what WHEN 'go' THEN list_filter(ahead, lambda x: NOT list_contains(freed, x))
      WHEN 'wait' THEN list_append(held, {{'seq': seq_no, 'since': clock, 'id': event_id}}) ELSE held END,
    list_transform(list_filter(waiting, lambda x: clock - x.since > 2000),
      lambda x: {{'id': x.id, 'action': 'buffer', 'outcome': 'expired', 'since': x.since}})
    || CASE what WHEN 'wait' THEN [] WHEN 'late' THEN [CASE WHEN age <= 2000
        THEN {{'id': event_id, 'action': 'reprocess', 'outcome': 'late', 'since': clock}}
        ELSE {{'id': event_id, 'action': 'drop', 'outcome': 'too_late', 'since': clock}} END]
      ELSE [{{'id': event_id, 'action': 'process', 'outcome': CASE WHEN seq_no = last + 1 THEN 'in_order'
          ELSE 'gap_skipped' END, 'since': clock}}]
        || list_transform(freed, lambda x: {{'id': x.id, 'action': 'buffer', 'outcome': 'released', 'since': x.since}})
        || list_transform(list_filter(held, lambda x: x.seq <= seq_no),
             lambda x: {{'id': x.id, 'action': 'buffer', 'outcome': 'overtaken', 'since': x.since}}) END
  FROM (
    SELECT *, list_filter(ahead, lambda x, i: x.seq = seq_no + i) AS freed FROM (
      SELECT *, list_sort(list_filter(held, lambda x: x.seq > seq_no)) AS ahead FROM (
        SELECT od.*, sq.last, sq.waiting, list_filter(sq.waiting, lambda x: od.clock - x.since <= 2000) AS held,
          CASE WHEN od.seq_no <= sq.last THEN 'late'
            WHEN od.seq_no - sq.last - 1 BETWEEN 1 AND 10 THEN 'wait' ELSE 'go' END AS what
        FROM sq JOIN od ON od.match_id = sq.match_id AND od.map_id = sq.map_id AND od.n = sq.n + 1) AS a) AS b) AS c),
ac AS (
  SELECT u.id AS event_id, u.action, u.outcome, u.since FROM (SELECT unnest(settled) AS u FROM sq) AS x
  UNION ALL
  SELECT w.id, 'buffer', 'waiting', w.since FROM (SELECT unnest(waiting) AS w FROM sq
    QUALIFY n = max(n) OVER (PARTITION BY match_id, map_id)) AS y),
av AS (
  SELECT od.match_id, od.map_id, event_id, od.seq_no, od.n AS arrival_no, action, outcome, since
  FROM ac JOIN od USING (event_id))"""


_ACTIONS = """
df AS (
  SELECT * FROM arr QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_key, copy_no) = 1),""" + _settled("""
  SELECT match_id, map_id, event_id, seq_no, ts_ingest_ms - ts_event_ms AS age, row_number() OVER w AS n,
    max(ts_ingest_ms) OVER w AS clock
  FROM df WINDOW w AS (PARTITION BY match_id, map_id ORDER BY arrival_key, event_id)""")
ORACLE["sequence_actions"] = sql(FX, ARR, _ACTIONS, recursive=True, body="SELECT * EXCLUDE (since) FROM av")
ORACLE["sequence_stats"] = sql(FX, ARR, _ACTIONS, recursive=True, body="""
    SELECT match_id, map_id, count(*) AS total_events,
      count(*) FILTER (action IN ('reprocess', 'drop')) AS out_of_order_events,
      count(*) FILTER (action = 'buffer' OR outcome = 'gap_skipped') AS gaps_detected,
      count(*) FILTER (outcome = 'released') AS late_events_processed,
      count(*) FILTER (action = 'drop' OR outcome IN ('expired', 'overtaken')) AS late_events_dropped
    FROM av GROUP BY match_id, map_id""")

# Valid events whose number ends in 7 or 9 are delivered hours late; some come again then.
_SOUND = "k <= 90 AND event_no % 41 <> 0 AND seq_no <> 7 AND round_no <= 50"
_MONTH = "CAST(strftime(epoch_ms(ts_event_ms), '%Y%m') AS INT)"
ORACLE["stream_late"] = sql(FX, ARR, WIRE, body=f"""
    SELECT event_id, match_id, {_MONTH} AS month, 'stored' AS outcome FROM wr
    WHERE {_SOUND} AND event_no % 10 IN (7, 9) AND copy_no = 0
    UNION ALL SELECT event_id, match_id, {_MONTH}, 'repeat' FROM wr
    WHERE {_SOUND} AND event_no % 10 IN (3, 5, 7) AND copy_no = 0""")
ORACLE["stream_conservation"] = sql(FX, ARR, WIRE, body=f"""
    , c AS (SELECT *, {_VALID} AS valid, {_SOUND} AND event_no % 10 IN (7, 9) AS held,
        CASE WHEN copy_no = 0 AND {_SOUND} THEN CASE event_no % 10 WHEN 3 THEN 2 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END
          ELSE 0 END AS again FROM wr),
    tot AS (SELECT CAST(count(*) + sum(again) AS BIGINT) AS received,
      count(DISTINCT event_id) FILTER (valid AND NOT held) AS stored,
      count(DISTINCT event_id) FILTER (valid AND held) AS late, count(*) FILTER (NOT valid) AS quarantined FROM c)
    SELECT *, received - stored - late - quarantined AS duplicate FROM tot""")
ORACLE["stream_raw_by_month"] = sql(FX, ARR, WIRE, body=f"""
    , d AS (SELECT DISTINCT event_id, ts_event_ms, seq_no FROM wr WHERE {_VALID})
    SELECT {_MONTH} AS month, count(*) AS events, CAST(sum(ts_event_ms) AS BIGINT) AS versions,
      max(seq_no) AS last_seq_no FROM d GROUP BY 1""")

# All matches at once, without every 97th event; what waits at the end expires by the watermark, 10 s behind.
_LIVE = """
lv AS (
  SELECT match_id, map_id, event_id, seq_no,
    CASE WHEN event_no % 50 = 0 THEN 5000 ELSE ts_ingest_ms - ts_event_ms END AS age,
    ts_event_ms - 1704067200000 - m * 420000 + age AS received
  FROM ev WHERE event_no % 97 <> 0),""" + _settled("""
  SELECT match_id, map_id, event_id, seq_no, age, row_number() OVER w AS n, max(received) OVER w AS clock
  FROM lv WINDOW w AS (PARTITION BY match_id, map_id ORDER BY received, event_id)""") + """,
fin AS (
  SELECT * REPLACE (CASE WHEN outcome = 'waiting' AND (SELECT max(received) FROM lv) - 10000 - since > 2000
    THEN 'expired' ELSE outcome END AS outcome) FROM av)"""
ORACLE["live_sequence"] = sql(FX, _LIVE, recursive=True, body="SELECT * EXCLUDE (since) FROM fin")
ORACLE["stream_sequence"] = sql(FX, _LIVE, recursive=True, body="""
    SELECT match_id, map_id, event_id, seq_no, action, outcome FROM fin WHERE outcome <> 'waiting'""")
ORACLE["stream_expiry"] = sql(FX, _LIVE, recursive=True, body="""
    SELECT match_id, map_id, event_id, seq_no, since AS since_ms FROM fin WHERE outcome = 'expired'""")

# Orders: the place is part of the row.
ORACLE["live_page"] = sql(MATCHES, TEAMS, body="""
    , n AS (SELECT ma.id, started_ms, a.name AS team_a_name, b.name AS team_b_name,
        row_number() OVER (ORDER BY started_ms DESC, ma.id) AS place
      FROM ma JOIN teams a ON a.id = team_a_id JOIN teams b ON b.id = team_b_id WHERE status = 'live')
    SELECT * FROM n WHERE place <= 50""")
ORACLE["match_page_after"] = ORACLE["match_page"]
ORACLE["prediction_curve"] = pred("""
    SELECT match_id, state_version, ts_calc_ms, round(p_team_a_win, 6) AS p_team_a_win,
      row_number() OVER (PARTITION BY match_id ORDER BY ts_calc_ms, map_id, state_version) AS place FROM pr""")
ORACLE["rounds_in_order"] = ev("""
    SELECT match_id, map_id, round_no, row_number() OVER (PARTITION BY match_id, map_id ORDER BY round_no) AS place
    FROM rm""", ROUNDS)
ORACLE["players_by_kills"] = f"""
    SELECT match_id, map_id, player_id, team, kills,
      row_number() OVER (PARTITION BY match_id, map_id ORDER BY kills DESC, player_id, team) AS place
    FROM ({ORACLE["player_stats"]}) AS s"""
ORACLE["types_by_count"] = f"""
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY events DESC, type) AS place
    FROM ({ORACLE["event_counts"]}) AS s"""
