"""Rows with null keys, unknown clients or nothing to measure stay in reports and audits."""

import pytest
from pyspark.sql import functions as F

from matchflow import session
from matchflow.functions import running as run
from matchflow.functions.joins import within
from matchflow.operators import evaluation, intake, slo, usage
from matchflow.sources import store

CLIENTS = "id long, tier string, quota_monthly int, permissions array<string>, allowed_ips array<string>"


@pytest.fixture(scope="module")
def clients(spark):
    return spark.createDataFrame([(1, "gold", None, ["view:*"], []), (2, "gold", 5, ["*"], ["10.0.0.1"]), (3, "x", None, None, None)], CLIENTS)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "view", 200, 5.0, 1_000), (1, None, 200, 7.0, 2_000), (2, "view", 500, None, 61_000), (9, "view", 200, 1.0, 3_000),
            (None, "view", 404, 2.0, 4_000), (3, "view", 200, 3.0, 5_000)]
    return spark.createDataFrame(rows, "client_id long, action string, status_code int, latency_ms double, ts_ms long").withColumn(
        "ip_address", F.lit("10.0.0.1"))


@pytest.mark.parametrize("exact", [True, False])
def test_usage_keeps_every_group(log, exact):
    rows = {(r["client_id"], r["action"]): r for r in usage.api_usage(log, exact).collect()}
    assert len(rows) == 6
    assert rows[2, "view"]["p50_ms"] is None and rows[1, None]["p50_ms"] == 7.0 and rows[None, "view"]["calls"] == 1


def test_quota_and_audits_keep_unknown_clients(log, clients):
    assert {r["client_id"]: r["quota"] for r in usage.quota_usage(log, clients).collect()}.keys() == {1, 2, 3, 9, None}
    scope = {(r["client_id"], r["action"]): r["allowed"] for r in usage.scope_check(log, clients, F.lit("view:matches")).collect()}
    assert scope == {(1, "view"): True, (1, None): True, (2, "view"): True, (9, "view"): False, (None, "view"): False, (3, "view"): False}
    ips = {r["client_id"]: r["allowed"] for r in usage.ip_check(log, clients).collect()}
    assert ips == {1: True, 2: True, 3: True, 9: False, None: False}


@pytest.mark.parametrize("exact", [True, False])
def test_objectives_keep_buckets_without_latency(log, exact):
    rows = log.withColumn("e2e_ms", F.col("latency_ms"))
    got = {r["bucket_ms"]: r for r in slo.latency_slo(rows, exact=exact).collect()}
    assert got[60_000]["total_events"] == 1 and got[60_000]["p95_ms"] is None and got[0]["total_events"] == 5
    assert slo.slo_status(rows, 60_000, exact=exact).count() == 2


def test_running_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, i, 1) for i in range(6)] + [(1, i, 1) for i in range(4)], "k long, o long, v long")
    got = run.running(rows, ["k"], ["o"], F.floor(F.col("o") / 2), t=run.total(F.col("v")))
    assert got.filter("k is null").agg(F.max("t")).first()[0] == 6 and got.count() == 10


def test_unknown_tier_keeps_its_rows(spark):
    rows = spark.sql("select date'2020-01-01' as day, explode(array('gold', 'none', null)) as tier")
    assert {r["tier"] for r in store.retain_by_tier(rows, "day", "tier", F.lit("2024-01-01").cast("date")).collect()} == {"none", None}


def test_size_counts_the_payload_as_it_is(spark):
    rows = spark.createDataFrame([("a", '"' * 64_000), ("a", '"' * 65_536), ("a", None)], "event_id string, payload string")
    assert [r[0] for r in rows.select(intake.size_rule(rows.columns)).collect()] == [True, False, True]


def test_limits_are_refused_not_cut(spark):
    assert within(5, 5) == 5
    with pytest.raises(ValueError):
        evaluation.latest_n(spark.range(3).withColumn("o", F.col("id")), ["id"], ["o"], 101)


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster())


def test_waiting_events_are_told_when_their_time_is_over():
    from matchflow.streaming.processors import SequenceProcessor

    class Cell:
        def __init__(self, held):
            self.held = held

        def get(self):
            return self.held

        put = update = lambda self, held: setattr(self, "held", held)
        clear = lambda self: setattr(self, "held", None)
        exists = lambda self: self.held is not None

    class Now:
        def getCurrentWatermarkInMs(self):
            return 2011

    shard = SequenceProcessor()
    shard.place, shard.waiting = Cell((3, 7, 10)), Cell([(7, 10, "e7"), (5, 10, "e5"), (6, 11, "e6")])
    (rows,) = shard.handleExpiredTimer(("m", "p"), Now(), None)
    assert sorted(rows.values.tolist()) == [
        ["m", "p", "e5", 5, "buffer", "expired", 10], ["m", "p", "e7", 7, "buffer", "expired", 10]]
    assert shard.waiting.held == [(6, 11, "e6")] and shard.place.exists()


def test_time_ranges_read_their_months_only(spark, tmp_path):
    rows = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-06-01', interval 10 days)) as ts_event").withColumns(
        {"month": store.month_number(F.col("ts_event")), "date": F.to_date("ts_event")})
    rows.write.partitionBy("month").parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    low, high = F.lit("2024-02-05").cast("timestamp"), F.lit("2024-03-05").cast("timestamp")
    some = evaluation.events_between(table, low, high)
    kept = store.retain(table, "date", 30, F.lit("2024-06-01").cast("date"))
    assert some.count() == rows.filter(F.col("ts_event").between(low, high)).count()
    assert kept.count() == rows.filter("date >= date'2024-05-02'").count()
    for frame in (some, kept):
        assert "PartitionFilters: [isnotnull(month" in frame._jdf.queryExecution().toString()
