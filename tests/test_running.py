"""Chunked aggregates equal plain windows, whatever the chunk size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchflow.functions import running as run

FIRST = Window.unboundedPreceding


@pytest.fixture(scope="module")
def rows(spark):
    """Three keys; one holds most rows."""
    n = F.col("id")
    return spark.range(900).select(
        F.when(n % 10 < 8, 0).otherwise(n % 3).alias("key"),
        n.alias("pos"),
        F.when(n % 7 != 0, F.pmod(F.hash("id"), F.lit(50))).alias("v"),
        (F.pmod(F.hash(n + 5), F.lit(11)) == 0).alias("mark"),
    ).cache()


def plain(rows):
    w = Window.partitionBy("key").orderBy("pos")
    upto, before = w.rowsBetween(FIRST, 0), w.rowsBetween(FIRST, -1)
    whole = Window.partitionBy("key")
    v = F.col("v")
    x = F.coalesce(v, F.lit(0)) - 24
    seg = rows.withColumn("seg", F.sum(F.col("mark").cast("int")).over(upto)).withColumn("cum", F.sum(x).over(upto))
    in_seg = Window.partitionBy("key", "seg").orderBy("pos").rowsBetween(FIRST, 0)
    value = F.coalesce(v, F.lit(0))
    return seg.select(
        "key", "pos",
        F.row_number().over(w).cast("long").alias("no"),
        F.coalesce(F.sum(v).over(upto), F.lit(0)).alias("total"),
        F.coalesce(F.sum(v).over(before), F.lit(0)).alias("prior_total"),
        F.sum(v).over(whole).alias("whole"),
        F.max(v).over(upto).alias("highest"),
        F.max(v).over(before).alias("prior_highest"),
        F.last(v, True).over(upto).alias("latest"),
        F.last(v, True).over(before).alias("prior_latest"),
        F.first(v, True).over(upto).alias("earliest"),
        F.lag("v").over(w).alias("previous"),
        # The marker row's own value does not count.
        (F.sum(value).over(in_seg) - F.when(F.col("seg") > 0, F.first(value).over(in_seg)).otherwise(0)).alias("since"),
        F.max(v).over(in_seg).alias("highest_since"),
        (F.col("cum") - F.least(F.lit(0), F.min("cum").over(upto))).alias("excess"),
    )


REQUESTS = {
    "no": lambda: run.row_number(),
    "total": lambda: run.total(F.col("v")),
    "prior_total": lambda: run.total(F.col("v"), prior=True),
    "whole": lambda: run.whole(F.col("v")),
    "highest": lambda: run.highest(F.col("v")),
    "prior_highest": lambda: run.highest(F.col("v"), prior=True),
    "latest": lambda: run.latest(F.col("v")),
    "prior_latest": lambda: run.latest(F.col("v"), prior=True),
    "earliest": lambda: run.earliest(F.col("v")),
    "previous": lambda: run.previous(F.col("v")),
    "since": lambda: run.since(F.coalesce("v", F.lit(0)), F.col("mark")),
    "highest_since": lambda: run.highest_since(F.col("v"), F.col("mark")),
    "excess": lambda: run.excess(F.coalesce("v", F.lit(0)) - 24),
}
ORDERED = {"since", "highest_since", "excess"}


@pytest.mark.parametrize("size", [7, 10_000])
@pytest.mark.parametrize("names", [list(REQUESTS), [n for n in REQUESTS if n not in ORDERED]])
def test_running_equals_plain_window(rows, size, names):
    got = run.running(rows, ["key"], ["pos"], F.floor(F.col("pos") / size), **{n: REQUESTS[n]() for n in names})
    columns = ["key", "pos", *names]
    want = {tuple(r)[:2]: tuple(r) for r in plain(rows).select(columns).collect()}
    have = {tuple(r)[:2]: tuple(r) for r in got.select(columns).collect()}
    assert have.keys() == want.keys()
    wrong = {columns[i]: (k, have[k][i], want[k][i]) for k in want for i in range(len(columns)) if have[k][i] != want[k][i]}
    assert not wrong


@pytest.mark.parametrize("size", [7, 50_000])
def test_sliding_equals_range_frame(spark, rows, monkeypatch, size):
    """Peers, far gaps, negative places, null keys and values, rows without a place."""
    monkeypatch.setattr(run, "CHUNK_ROWS", size)
    n = F.col("pos")
    more = rows.select("key", F.when(n % 11 == 0, n * 1000).otherwise(F.floor(n / 3) - 40).alias("pos"), "v").unionByName(
        spark.createDataFrame([(None, 5, 1), (None, 6, 2), (None, 99, 3), (1, None, 4), (None, None, 5)], "key int, pos long, v int"))
    w = Window.partitionBy("key").orderBy("pos").rangeBetween(-12, 0)
    placed = more.filter("pos IS NOT NULL")
    want = placed.select("key", "pos", F.coalesce(F.sum("v").over(w), F.lit(0)), F.count("*").over(w)).collect()
    got = run.sliding(more, ["key"], "pos", 13, s=F.col("v"), n=F.lit(1))
    have = got.filter("pos IS NOT NULL").select("key", "pos", "s", "n").collect()
    assert sorted(str(tuple(r)) for r in have) == sorted(str(tuple(r)) for r in want)
    assert got.count() == len(want) + 2 and got.filter("pos IS NULL AND n IS NULL").count() == 2
    assert "RangeFrame" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_windowed_rows_are_not_shuffled_again_for_the_join(spark, rows):
    """Of four shuffles only the two of the slim rows and of the ends move rows; the join is on what they are dealt by."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run.running(rows, ["key"], ["pos"], F.floor(F.col("pos") / 50), x=run.since(F.lit(1), F.col("mark")))
        plan = got._jdf.queryExecution().sparkPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan[1].split("\n") if "Exchange hashpartitioning" in line]
        assert len(dealt) == 4 and not any("coalesce" in line or "isnull" in line for line in dealt)
        assert got.count() == rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("size", [7, 5000])
def test_ends_only_gives_the_last_rows_of_chunks(rows, size):
    requests = {"t": run.total(F.col("v")), "s": run.since(F.lit(1), F.col("mark")), "l": run.latest(F.col("v"))}
    chunk = F.floor(F.col("pos") / size)
    every = run.running(rows, ["key"], ["pos"], chunk, **requests)
    last = every.join(rows.groupBy("key", chunk.alias("c")).agg(F.max("pos").alias("pos")).drop("c"), ["key", "pos"]).select(every.columns)
    ends = run.running(rows, ["key"], ["pos"], chunk, True, **requests)
    assert ends.columns == every.columns
    assert sorted(map(str, ends.collect())) == sorted(map(str, last.collect()))
