"""Alert rules over counters and gauges as they are scraped, minute by minute.

Samples are rows of one minute (``step``) per series: cumulative counters that
start again at zero when their process does, and gauges. Rules look at rates
over the last minutes, minutes without a sample included, and go from pending
to firing when they hold long enough. Nothing here grows with events, only
with series and minutes: windows run over one series, a row per minute.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.operators.slo import histogram_quantile


@dataclass(frozen=True)
class Rule:
    severity: str
    above: float
    hold: int  # minutes the condition must last before the alert fires


# Fixed values of the alert rules.
RULES = {
    "high_error_rate": Rule("warning", 0.01, 2),  # share of 5xx answers
    "high_latency_p95": Rule("warning", 500.0, 5),  # milliseconds
    "consumer_lag": Rule("critical", 5_000.0, 1),  # events that wait
    "rate_limit_spike": Rule("warning", 50.0, 1),  # refusals (429) a second
    "invalid_signatures": Rule("warning", 5.0, 1),  # a second
}
STALE = 5  # minutes a gauge counts after its last sample


def increases(samples: DataFrame, labels: list[str]) -> DataFrame:
    """How much each counter grew since its previous sample, as ``grown``.

    A counter below its previous value was restarted and grew from zero, as a
    new series does.
    """
    before = F.lag("value").over(Window.partitionBy(*labels).orderBy("step"))
    fresh = before.isNull() | (F.col("value") < before)
    return samples.withColumn("grown", F.when(fresh, F.col("value")).otherwise(F.col("value") - before))


def over_range(points: DataFrame, labels: list[str], width: int, until: Column, **sums: Column) -> DataFrame:
    """Sums over the minutes ``(t - width, t]`` at every ``t`` up to ``until`` that has a point among them.

    Points are summed per minute first, then each minute counts in ``width``
    sums: hash aggregates only, and no gap needs a row.
    """
    minutes = points.groupBy(*labels, "step").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    at = F.explode(F.sequence(F.col("step"), F.col("step") + (width - 1)))
    seen = minutes.select(*labels, at.alias("step"), *sums)
    return seen.filter(F.col("step") <= until).groupBy(*labels, "step").agg(*(F.sum(n).alias(n) for n in sums))


def held(samples: DataFrame, labels: list[str], until: Column, stale: int = STALE) -> DataFrame:
    """A gauge at every minute: its last sample, for at most ``stale`` minutes."""
    following = F.lead("step").over(Window.partitionBy(*labels).orderBy("step"))
    last = F.least(F.coalesce(following - 1, until), F.col("step") + (stale - 1), until)
    lasting = samples.withColumn("__last", last).filter(F.col("__last") >= F.col("step"))
    at = F.explode(F.sequence(F.col("step"), F.col("__last")))
    return lasting.select(*labels, at.alias("step"), "value")


def rates(samples: DataFrame, until: Column) -> DataFrame:
    """Values of all rules by service and minute, over samples ``(metric, label, service, instance, step, value)``.

    ``requests`` is labelled with the status code, ``duration`` with the
    upper bound in milliseconds, ``ingest_errors`` with the kind of error;
    ``lag`` is a gauge.
    """
    grown = increases(samples.filter("metric <> 'lag'"), ["metric", "label", "service", "instance"])
    requests = grown.filter("metric = 'requests'")

    def amount(condition: Column) -> Column:
        return F.when(condition, F.col("grown")).otherwise(0)

    errors = over_range(requests, ["service"], 5, until, bad=amount(F.col("label").startswith("5")), all=F.col("grown"))
    bounds = over_range(
        grown.filter("metric = 'duration'").withColumn("le", F.col("label").cast("double")),
        ["service", "le"], 5, until, n=F.col("grown"))
    # Bounds that see a restart differently may cross; counts must not fall along the bounds.
    place = Window.partitionBy("service", "step")
    hist = bounds.withColumns({
        "cumulative": F.max("n").over(place.orderBy("le")), "count": F.max("n").over(place)})
    minute = {
        "rate_limit_spike": requests.filter("label = '429'"),
        "invalid_signatures": grown.filter("metric = 'ingest_errors' AND label = 'auth_invalid_signature'"),
    }
    lag = held(samples.filter("metric = 'lag'"), ["service", "instance"], until)

    def series(rule: str, rows: DataFrame, value: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), "service", "step", value.cast("double").alias("value"))

    out = series("high_error_rate", errors, F.try_divide(F.col("bad"), F.col("all")))
    out = out.unionByName(series(
        "high_latency_p95", histogram_quantile(hist, ["service", "step"], 0.95), F.col("quantile")))
    out = out.unionByName(series(
        "consumer_lag", lag.groupBy("service", "step").agg(F.sum("value").alias("v")), F.col("v")))
    for rule, rows in minute.items():
        per_minute = over_range(rows, ["service"], 1, until, n=F.col("grown"))
        out = out.unionByName(series(rule, per_minute, F.col("n") / 60))
    return out


def alerts(values: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Runs of minutes on which a rule holds: pending from the first, firing once it held long enough.

    ``firing_from`` is null when the condition ended while pending. A minute
    without a value ends a run; rules that are not given are left out.
    """
    def of(field: str) -> Column:
        return F.create_map(*(F.lit(x) for name, r in rules.items() for x in (name, getattr(r, field))))[F.col("rule")]

    one = Window.partitionBy("rule", "service").orderBy("step")
    holding = values.filter(F.col("rule").isin(list(rules)) & (F.col("value") > of("above"))).withColumn(
        "__run", F.col("step") - F.row_number().over(one))
    runs = holding.groupBy("rule", "service", "__run").agg(
        F.min("step").alias("pending_from"), F.max("step").alias("last_step"), F.max("value").alias("peak"))
    fires = F.col("pending_from") + of("hold")
    return runs.select(
        "rule", of("severity").alias("severity"), "service", "pending_from",
        F.when(fires <= F.col("last_step"), fires).alias("firing_from"), "last_step", "peak")
