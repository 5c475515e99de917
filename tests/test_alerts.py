from pyspark.sql import functions as F

from matchflow.operators import alerts

SAMPLES = "metric string, label string, service string, instance long, step long, value long"


def samples(spark, *rows):
    return spark.createDataFrame(list(rows), SAMPLES)


def requests(spark, status, values, instance=0, service="api"):
    return [("requests", status, service, instance, step, value) for step, value in values]


def test_restart_counts_from_zero(spark):
    rows = samples(spark, *requests(spark, "200", [(0, 5), (1, 9), (4, 9), (5, 3), (6, 8)]))
    got = alerts.increases(rows, ["service", "instance"]).orderBy("step").collect()
    assert [r.grown for r in got] == [5, 4, 0, 3, 5]


def test_rates_cover_minutes_without_a_sample(spark):
    rows = samples(spark, *requests(spark, "200", [(0, 90)]), *requests(spark, "500", [(0, 10), (9, 11)]))
    got = {r.step: r.value for r in alerts.rates(rows, F.lit(9)).filter("rule = 'high_error_rate'").collect()}
    assert got == {0: 0.1, 1: 0.1, 2: 0.1, 3: 0.1, 4: 0.1, 9: 1.0}  # nothing is known of 5 to 8 or after 9


def test_processes_of_a_service_add(spark):
    rows = samples(spark, *requests(spark, "500", [(0, 1), (1, 1)]), *requests(spark, "200", [(0, 3), (1, 3)], instance=1))
    got = alerts.rates(rows, F.lit(1)).filter("rule = 'high_error_rate'").collect()
    assert {(r.step, r.value) for r in got} == {(0, 0.25), (1, 0.25)}


def test_pending_and_firing(spark):
    rule = {"high_error_rate": alerts.Rule("warning", 0.5, 2)}
    steps = [(1, 0.9), (2, 0.9), (4, 0.9), (5, 0.8), (6, 0.7), (7, 0.5), (8, None), (9, 0.6)]
    rows = spark.createDataFrame([("high_error_rate", "api", s, v) for s, v in steps] + [("other", "api", 1, 9.0)],
                                 "rule string, service string, step long, value double")
    got = [(r.pending_from, r.firing_from, r.last_step, r.peak) for r in alerts.alerts(rows, rule).orderBy("pending_from").collect()]
    assert got == [(1, None, 2, 0.9), (4, 6, 6, 0.9), (9, None, 9, 0.6)]


def test_gauge_lasts_until_next_sample_or_stale(spark):
    rows = samples(spark, ("lag", "", "api", 0, 0, 7), ("lag", "", "api", 0, 2, 9), ("lag", "", "api", 0, 20, 1))
    got = {r.step: r.value for r in alerts.held(rows, ["service", "instance"], F.lit(21)).collect()}
    assert got == {0: 7, 1: 7, 2: 9, 3: 9, 4: 9, 5: 9, 6: 9, 20: 1, 21: 1}


def test_latency_quantile_of_growing_buckets(spark):
    bound = lambda le, values: [("duration", le, "api", 0, s, v) for s, v in values]
    rows = samples(spark, *bound("100", [(0, 0), (1, 10)]), *bound("500", [(0, 0), (1, 10)]),
                   *bound("1000", [(0, 0), (1, 20)]), *bound("Infinity", [(0, 0), (1, 20)]))
    got = {r.step: r.value for r in alerts.rates(rows, F.lit(1)).filter("rule = 'high_latency_p95'").collect()}
    assert got == {1: 950.0}


def test_no_sample(spark):
    values = alerts.rates(samples(spark), F.lit(0))
    assert values.count() == 0 and alerts.alerts(values, alerts.RULES).count() == 0
