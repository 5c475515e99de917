"""API usage: quotas, access checks, flags, audit and the webhook outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions import quantiles as qt
from matchflow.functions import running as run
from matchflow.functions.joins import join_null_safe
from matchflow.session import cut


def api_usage(log: DataFrame, exact: bool = True) -> DataFrame:
    """Calls, status mix and latency quantiles per client and action; groups without any latency or key stay.

    The log is read once, into partials per client, action and latency.
    """
    keys = ["client_id", "action"]
    code = F.col("status_code")
    parts = cut(qt.partials(
        log, keys, "latency_ms", ok=F.when(code < 400, 1).otherwise(0),
        client_errors=F.when((code >= 400) & (code < 500), 1).otherwise(0),
        server_errors=F.when(code >= 500, 1).otherwise(0),
    ))
    timed = F.when(F.col("latency_ms").isNotNull(), F.col("n"))
    totals = parts.groupBy(*keys).agg(
        F.sum("n").alias("calls"), *(F.sum(c).alias(c) for c in ("ok", "client_errors", "server_errors")),
        F.try_divide(F.sum(F.col("latency_ms") * timed), F.sum(timed)).alias("avg_ms"),
    )
    wanted = {"p50_ms": 0.5, "p95_ms": 0.95}
    found = qt.exact(parts, keys, "latency_ms", wanted) if exact else qt.approx(
        qt.bands(parts, keys, "latency_ms"), keys, wanted)
    return join_null_safe(totals, found, keys)


def sliding_rate(log: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Requests of the client in the ``window_ms`` up to each request."""
    return run.sliding(log, ["client_id"], "ts_ms", window_ms, requests_in_window=F.lit(1))


def quota_usage(log: DataFrame, clients: DataFrame) -> DataFrame:
    """Calls per client and month against the client's or its tier's quota; unknown clients have none."""
    month = F.date_format(F.timestamp_millis("ts_ms"), "yyyyMM").cast("int")
    used = log.groupBy("client_id", month.alias("month")).agg(F.count("*").alias("used"))
    tiers = F.create_map(*(F.lit(x) for pair in sc.TIER_MONTHLY_QUOTA.items() for x in pair))
    limits = clients.select(
        F.col("id").alias("client_id"), "tier",
        F.coalesce(F.col("quota_monthly").cast("long"), F.try_element_at(tiers, F.col("tier")).cast("long"))
        .alias("quota"),
    )
    return used.join(limits, "client_id", "left").withColumn("share", F.col("used") / F.col("quota"))


def has_scope(permissions: str, needed: Column) -> Column:
    """``*``, the exact scope, or every resource of the action."""
    category = F.concat(F.substring_index(needed, ":", 1), F.lit(":*"))
    scopes = F.col(permissions)
    return (
        F.array_contains(scopes, "*") | F.array_contains(scopes, needed) | F.array_contains(scopes, category)
    )


def scope_check(log: DataFrame, clients: DataFrame, needed: Column) -> DataFrame:
    """Audit of the access log: was each call within the client's scopes. Calls of unknown clients were not."""
    held = clients.select(F.col("id").alias("client_id"), "permissions")
    return log.withColumn("needed", needed).join(held, "client_id", "left").withColumn(
        "allowed", F.coalesce(has_scope("permissions", F.col("needed")), F.lit(False))
    )


def ip_allowed(allowed: str, ip: Column) -> Column:
    """No list allows all; else the address itself or a /24 network with its prefix."""
    network = F.substring_index(ip, ".", 3)

    def matches(entry: Column) -> Column:
        in_network = entry.endswith("/24") & (F.substring_index(entry, ".", 3) == network)
        return (entry == ip) | in_network

    return (F.size(allowed) == 0) | F.exists(F.col(allowed), matches)


def ip_check(log: DataFrame, clients: DataFrame) -> DataFrame:
    """Whether each call came from an address its client may use; an unknown client may use none."""
    held = clients.select(
        F.col("id").alias("client_id"), F.coalesce("allowed_ips", F.array().cast("array<string>")).alias("allowed_ips"))
    return log.join(held, "client_id", "left").withColumn(
        "allowed", F.coalesce(ip_allowed("allowed_ips", F.col("ip_address")) & F.col("allowed_ips").isNotNull(), F.lit(False)))


def key_audit(attempts: DataFrame, clients: DataFrame) -> DataFrame:
    """Which presented keys are valid: known prefix, matching secret, active client."""
    known = clients.select("key_prefix", F.col("id").alias("client_id"), "key_hash", "is_active")
    same = F.sha2(F.col("secret").cast("binary"), 256) == F.col("key_hash")
    return attempts.join(known, "key_prefix", "left").withColumn(
        "valid", F.coalesce(same & F.col("is_active"), F.lit(False))
    )


def effective_flags(checks: DataFrame, flags: DataFrame) -> DataFrame:
    """Resolve flag checks ``(client_id, name)``: the client's own row wins over
    the global one, and without either the flag is off.

    Two equi-joins. Clients are not multiplied by flags: a pair nobody asked
    for needs no row.
    """
    own = flags.filter(F.col("client_id").isNotNull()).select("client_id", "name", F.col("is_enabled").alias("own"))
    everyone = flags.filter(F.col("client_id").isNull()).select("name", F.col("is_enabled").alias("everyone"))
    joined = checks.join(everyone, "name", "left").join(own, ["client_id", "name"], "left")
    return joined.withColumn("is_enabled", F.coalesce("own", "everyone", F.lit(False))).drop("own", "everyone")


def webhook_audience(clients: DataFrame) -> DataFrame:
    """Active clients with a webhook address: who gets every update."""
    return clients.filter(F.col("is_active") & F.col("webhook_url").isNotNull()).select(
        F.col("id").alias("client_id"), "webhook_url"
    )


def webhook_outbox(updates: DataFrame, clients: DataFrame) -> DataFrame:
    """Updates to deliver, each with the size and mark of its audience.

    Every update goes to every client of the audience. Their product is not
    stored: the outbox keeps one row per update and ``webhook_audience`` one
    row per client. A sender takes both; ``audience`` tells it whether the
    audience is still the one the update was queued for.
    """
    audience = webhook_audience(clients)
    who = F.md5(F.concat_ws(" ", F.col("client_id").cast("string"), "webhook_url"))
    mark = F.sum(F.conv(F.substring(who, 1, 8), 16, 10).cast("long"))
    return updates.withColumns({
        "recipients": audience.agg(F.count("*").alias("n")).scalar(),
        "audience": F.coalesce(audience.agg(mark.alias("m")).scalar(), F.lit(0).cast("long")),
    })


def audit_recent(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest calls of every client."""
    newest = Window.partitionBy("client_id").orderBy(F.col("ts_ms").desc(), F.col("request_id").desc())
    return log.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)
