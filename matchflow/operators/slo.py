"""Latency and error objectives, histograms, alerts and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.functions import quantiles as qt
from matchflow.functions.joins import join_null_safe
from matchflow.functions.scalars import count_if, error_status, latency_status
from matchflow.session import cut

HOUR_MS = 3_600_000


def bucket_ms(ts_ms: str, width_ms: int) -> Column:
    return (F.floor(F.col(ts_ms) / width_ms) * width_ms).cast("long")


def latency_partials(log: DataFrame, width_ms: int = 60_000) -> DataFrame:
    """How often each latency occurs per time bucket: one scan of the log, kept as a table."""
    rows = log.select(bucket_ms("ts_ms", width_ms).alias("bucket_ms"), "e2e_ms")
    return cut(qt.partials(rows, ["bucket_ms"], "e2e_ms"))


def latency_sketch(parts: DataFrame, width_ms: int = 60_000) -> DataFrame:
    """Sketch per time bucket, from partials or from a sketch of narrower buckets whose width divides this one."""
    wider = parts.withColumn("bucket_ms", bucket_ms("bucket_ms", width_ms))
    return qt.merge(wider, ["bucket_ms"]) if "low" in parts.columns else qt.bands(wider, ["bucket_ms"], "e2e_ms")


def _quantiles(parts: DataFrame, groups: list[str], value: str, wanted: dict[str, float], exact: bool) -> DataFrame:
    """Exact interpolated quantiles, or those of the sketch."""
    if exact:
        return qt.exact(parts, groups, value, wanted)
    return qt.approx(qt.bands(parts, groups, value), groups, wanted)


def _objective(parts: DataFrame, threshold_ms: float) -> DataFrame:
    """Events, how many met the objective, and the maximum per bucket; a missing latency did not meet it."""
    met = F.coalesce(F.sum(F.when(F.col("e2e_ms") <= threshold_ms, F.col("n"))), F.lit(0).cast("long"))
    return parts.groupBy("bucket_ms").agg(
        F.sum("n").alias("total_events"), met.alias("met_slo"), F.max("e2e_ms").alias("max_ms")
    ).withColumn("slo_percentage", F.col("met_slo") / F.col("total_events") * 100)


def latency_slo(
    log: DataFrame, width_ms: int = 60_000, threshold_ms: float = sc.LATENCY_TARGET_MS, exact: bool = True
) -> DataFrame:
    """Per time bucket: events, how many met the objective, quantiles, maximum; buckets without a latency stay."""
    parts = latency_partials(log, width_ms)
    wanted = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    quantiles = _quantiles(parts, ["bucket_ms"], "e2e_ms", wanted, exact)
    return join_null_safe(_objective(parts, threshold_ms), quantiles, ["bucket_ms"])


def latency_rollup(minutes: DataFrame, width_ms: int, wanted: dict[str, float]) -> DataFrame:
    """Quantiles of wider buckets from the stored sketch of each minute; no event is read."""
    return qt.approx(latency_sketch(minutes, width_ms), ["bucket_ms"], wanted)


def stage_latency(log: DataFrame, exact: bool = True) -> DataFrame:
    """p95 of each processing stage."""
    stages = F.array(*(
        F.struct(F.lit(s).alias("stage"), F.col(f"{s}_ms").alias("ms")) for s in ("ingest", "queue", "state", "predict")
    ))
    long = log.select(F.explode(stages).alias("e")).select("e.*")
    return _quantiles(cut(qt.partials(long, ["stage"], "ms")), ["stage"], "ms", {"p95_ms": 0.95}, exact)


def slo_status(log: DataFrame, width_ms: int = 300_000, threshold_ms: float = sc.LATENCY_TARGET_MS,
               exact: bool = True) -> DataFrame:
    """Share of events within the objective and status per window."""
    parts = latency_partials(log, width_ms)
    share = _objective(parts, threshold_ms).select(
        "bucket_ms", F.col("total_events").alias("events"), F.col("slo_percentage").alias("compliance_percent"))
    p95 = _quantiles(parts, ["bucket_ms"], "e2e_ms", {"p95_ms": 0.95}, exact)
    return join_null_safe(share, p95, ["bucket_ms"]).withColumn("status", latency_status(F.col("p95_ms")))


def error_rate(log: DataFrame, width_ms: int = 300_000) -> DataFrame:
    rate = F.count_if(F.col("status_code") >= 500) / F.count("*") * 100
    return (
        log.groupBy(bucket_ms("ts_ms", width_ms).alias("bucket_ms"))
        .agg(F.count("*").alias("requests"), count_if(F.col("status_code") >= 500).alias("errors"),
             rate.alias("error_percent"))
        .withColumn("status", error_status(F.col("error_percent")))
    )


def error_budget(log: DataFrame, target: float = 0.999, days: int = 28, label: str = "service") -> DataFrame:
    """Per service and hour: budget of the rolling window, share consumed, burn flags.

    Windows run over one row per hour, never over requests.
    """
    hours = log.groupBy(label, F.floor(F.col("ts_ms") / HOUR_MS).cast("long").alias("hour")).agg(
        F.count("*").alias("requests"), count_if(F.col("status_code") >= 500).alias("errors")
    )

    def over(n: int, name: str) -> Column:
        return F.sum(name).over(Window.partitionBy(label).orderBy("hour").rangeBetween(-(n - 1), 0))

    allowed = over(days * 24, "requests") * (1 - target)
    return hours.select(
        label, (F.col("hour") * HOUR_MS).alias("hour_ms"), "requests", "errors",
        allowed.alias("allowed_errors"),
        (over(days * 24, "errors") / allowed).alias("consumed"),
        (F.col("errors") / allowed > 0.02).alias("fast_burn"),
        (over(24, "errors") / allowed > 0.05).alias("slow_burn"),
    )


def histogram(df: DataFrame, value: str, labels: list[str], buckets: list[float]) -> DataFrame:
    """Cumulative counts per label and upper bound, with count and sum.

    One counter per bucket inside the aggregate; rows are not multiplied.
    """
    totals = df.groupBy(*labels).agg(
        *(count_if(F.col(value) <= le).alias(f"_b{i}") for i, le in enumerate(buckets)),
        F.count(value).alias("count"), F.sum(value).alias("sum"),
    )
    bounds = [F.struct(F.lit(float(le)).alias("le"), F.col(f"_b{i}").alias("n")) for i, le in enumerate(buckets)]
    bounds.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return totals.select(*labels, "count", "sum", F.explode(F.array(*bounds)).alias("b")).select(
        *labels, "b.le", F.col("b.n").alias("cumulative"), "count", "sum"
    )


def histogram_quantile(hist: DataFrame, labels: list[str], q: float) -> DataFrame:
    """Quantile by interpolation inside the first bucket that reaches it.

    In the open last bucket the highest finite bound is returned.
    """
    w = Window.partitionBy(*labels).orderBy("le")
    steps = hist.withColumns({
        "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
        "before": F.coalesce(F.lag("cumulative").over(w), F.lit(0).cast("long")),
        "rank": F.col("count") * F.lit(float(q)),
    })
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (
        F.col("cumulative") - F.col("before")
    )
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    hit = (F.col("cumulative") >= F.col("rank")) & (F.col("before") < F.col("rank"))
    return steps.filter(hit).select(*labels, value.alias("quantile"))


def throughput(events: DataFrame, ts_ms: Column, kind: str, width_ms: int = 60_000) -> DataFrame:
    """Events per window and second by type."""
    window = (F.floor(ts_ms / width_ms) * width_ms).cast("long")
    return events.groupBy(window.alias("bucket_ms"), kind).agg(
        F.count("*").alias("events"), (F.count("*") / (width_ms / 1000)).alias("per_second")
    )


def alert_runs(series: DataFrame, labels: list[str], step: str, condition: Column, at_least: int) -> DataFrame:
    """Runs of consecutive steps on which a condition holds, of at least
    ``at_least`` steps. ``series`` has one row per step (for example minute)."""
    w = Window.partitionBy(*labels).orderBy(step)
    holding = series.filter(condition).withColumn("_island", F.col(step) - F.row_number().over(w))
    runs = holding.groupBy(*labels, "_island").agg(F.min(step).alias("run_start"), F.count("*").alias("run_length"))
    return runs.filter(F.col("run_length") >= at_least).drop("_island")


def rate_limited_clients(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status_code") == 429).groupBy("client_id").agg(F.count("*").alias("rate_limited"))


def queue_lag(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Lag per event, 0 where a time is missing."""
    return events.withColumn("lag_ms", F.coalesce(end - start, F.lit(0).cast("long")))


def system_summary(spark, events: DataFrame, predictions: DataFrame, matches: DataFrame, latency: DataFrame,
                   log: DataFrame) -> DataFrame:
    """One row of totals; each part is a scalar subquery over its own table."""
    count = F.count("*").alias("n")
    return spark.range(1).select(
        events.agg(count).scalar().alias("events"),
        predictions.agg(count).scalar().alias("predictions"),
        matches.filter(F.col("status") == "live").agg(count).scalar().alias("active_matches"),
        latency.agg(F.avg("e2e_ms").alias("ms")).scalar().alias("avg_latency_ms"),
        log.agg((F.count_if(F.col("status_code") >= 500) / F.count("*")).alias("r")).scalar().alias("error_rate"),
    )
