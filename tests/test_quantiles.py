import math
import random

import pytest
from pyspark.sql import functions as F

from matchflow.functions import quantiles as qt
from matchflow.operators import slo, usage

WANTED = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 1.0}


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(5)
    rows = [("wide", rnd.lognormvariate(4, 2)) for _ in range(4_000)]
    rows += [("signed", rnd.uniform(-900, 900)) for _ in range(2_000)]
    rows += [("same", 250.0)] * 3_000 + [("one", 7.0)] + [("ties", float(rnd.randrange(4))) for _ in range(999)]
    rows += [(None, float(x)) for x in range(50)] + [("same", None), ("gone", None)]
    return rows


def plain(values):
    groups = {}
    for key, v in values:
        if v is not None:
            groups.setdefault(key, []).append(v)
    out = {}
    for key, vs in groups.items():
        vs.sort()
        spots = {n: (len(vs) - 1) * q for n, q in WANTED.items()}
        out[key] = {n: vs[int(p)] + (vs[math.ceil(p)] - vs[int(p)]) * (p - int(p)) for n, p in spots.items()}
    return out


def parts(spark, values):
    return qt.partials(spark.createDataFrame(values, "key string, v double"), ["key"], "v")


def test_exact_equals_sorting(spark, values):
    got = {r.key: r for r in qt.exact(parts(spark, values), ["key"], "v", WANTED).collect()}
    want = plain(values)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert {n: got[key][n] for n in WANTED} == pytest.approx(row)


def test_sketch_is_off_by_no_more_than_stated(spark, values):
    got = {r.key: r for r in qt.approx(qt.bands(parts(spark, values), ["key"], "v"), ["key"], WANTED).collect()}
    for key, row in plain(values).items():
        for name, value in row.items():
            if key == "signed" and name == "b":
                continue  # between bands of either sign, see below
            assert abs(got[key][name] - value) <= qt.ERROR * (abs(value) + 1) * 1.0001, (key, name)
    assert abs(got["signed"]["b"] - plain(values)["signed"]["b"]) < 2


def test_sketches_of_parts_add(spark, values):
    rows = spark.createDataFrame(values, "key string, v double").withColumn("slot", F.hash("v") % 7)
    fine = qt.bands(qt.partials(rows, ["key", "slot"], "v"), ["key", "slot"], "v")
    both = [{(r.key, r.band, r.n, r.low, r.high) for r in s.select("key", "band", "n", "low", "high").collect()}
            for s in (qt.merge(fine, ["key"]), qt.bands(parts(spark, values), ["key"], "v"))]
    assert both[0] == both[1]
    widths = fine.groupBy("key", "slot").count().agg(F.max("count")).first()[0]
    assert widths < 1_000  # a sketch stays small


def test_nan_is_largest(spark):
    rows = [("k", float("nan")), ("k", 1.0), ("k", 0.0)]
    got = qt.exact(parts(spark, rows), ["key"], "v", {"mid": 0.5, "top": 1.0}).first()
    assert got.mid == 1.0 and math.isnan(got.top)


def test_empty(spark):
    assert qt.exact(parts(spark, []), ["key"], "v", WANTED).count() == 0
    assert qt.approx(qt.bands(parts(spark, []), ["key"], "v"), ["key"], WANTED).count() == 0


def test_log_is_read_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(500).select(
        (F.col("id") * 700).alias("ts_ms"), (F.col("id") % 90).cast("double").alias("e2e_ms"), (F.col("id") % 3).alias("client_id"),
        F.lit("view").alias("action"), F.lit(200).alias("status_code"), F.col("id").cast("double").alias("latency_ms"),
    ).write.parquet(path)
    log = spark.read.parquet(path)
    for result in (slo.latency_slo(log), slo.slo_status(log), usage.api_usage(log)):
        assert not [f for f in result.inputFiles() if path in f]  # partials only
        assert result.count() > 0


def test_minutes_roll_up_to_any_width(spark):
    rows = spark.range(20_000).select(
        (F.col("id") * 997 % 7_200_000).alias("ts_ms"), (F.col("id") * 31 % 1009).cast("double").alias("e2e_ms"))
    minutes = slo.latency_sketch(slo.latency_partials(rows))
    got = {r.bucket_ms: r for r in slo.latency_rollup(minutes, 3_600_000, {"p95_ms": 0.95}).collect()}
    want = {r.bucket_ms: r for r in slo.latency_slo(rows, 3_600_000).collect()}
    assert got.keys() == want.keys()
    for at, row in want.items():
        assert abs(got[at].p95_ms - row.p95_ms) <= qt.ERROR * (row.p95_ms + 1)
