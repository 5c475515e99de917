"""Merged tables, Bloom filters and the intake sink that writes to both."""

import json
import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow import schema as sc
from matchflow.functions import bloom
from matchflow.sources import store
from matchflow.sources.merged import MergedTable
from matchflow.streaming import pipeline as pl
from tests.test_intake import GOOD, ID

SCHEMA = T.StructType([T.StructField(n, t()) for n, t in (
    ("match_id", T.StringType), ("seq_no", T.LongType), ("version", T.LongType), ("note", T.StringType))])


def table(spark, path):
    return MergedTable(spark, f"{path}/t", SCHEMA, ["match_id", "seq_no"], ["version"])


def rows(spark, *given):
    return spark.createDataFrame([(*g, f"{g[0]}{g[1]}v{g[2]}") for g in given], "match_id string, seq_no long, version long, month int, note string")


def content(t, months=None):
    return sorted((r.month, r.match_id, r.seq_no, r.version, r.note) for r in t.read(months).collect())


def files(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


def test_highest_version_of_base_and_deltas(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0
    t.write(rows(spark, ("m", 1, 1, 202401), ("m", 2, 1, 202401), ("n", 1, 1, 202402)), "q-0")
    t.write(rows(spark, ("m", 1, 3, 202401), ("m", 3, 1, 202401)), "q-1")
    t.write(rows(spark, ("m", 1, 2, 202401)), "q-2")
    want = [(202401, "m", 1, 3, "m1v3"), (202401, "m", 2, 1, "m2v1"), (202401, "m", 3, 1, "m3v1"), (202402, "n", 1, 1, "n1v1")]
    assert content(t) == want
    assert content(t, [202402]) == want[3:]
    t.write(rows(spark, ("m", 1, 3, 202401), ("m", 3, 1, 202401)), "q-1")  # the batch once more
    assert content(t) == want and t.deltas().count() == 6
    t.compact([202401], sweep=False)
    assert content(t) == want and list(t.open_months()) == [202401, 202402]  # rows are in base and deltas
    t.compact()
    assert content(t) == want and not t.open_months()
    t.write(rows(spark, ("m", 2, 5, 202401)), "q-3")
    assert content(t)[1] == (202401, "m", 2, 5, "m2v5")


def test_files_stay_few_however_many_batches(spark, tmp_path):
    t = table(spark, tmp_path)
    most = 0
    for batch in range(12):
        t.write(rows(spark, *((f"m{batch}", n, batch, 202401 + n % 2) for n in range(20))), f"q-{batch}")
        if batch % 3 == 2:
            t.compact()
            most = max(most, files(tmp_path))
    assert t.read().count() == 240
    assert t.editions(202401) == [3, 4]  # the newest, and one for readers still at work
    assert most <= 2 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_unfinished_editions_are_not_read(spark, tmp_path):
    t = table(spark, tmp_path)
    t.write(rows(spark, ("m", 1, 1, 202401)), "q-0")
    t.compact()
    rows(spark, ("m", 1, 9, 202401)).drop("month").write.parquet(f"{tmp_path}/t/base/month=202401/edition=2")
    os.remove(f"{tmp_path}/t/base/month=202401/edition=2/_SUCCESS")
    assert content(t) == [(202401, "m", 1, 1, "m1v1")]


def test_filter_never_forgets_and_seldom_errs(spark):
    pick = random.Random(1)
    ids = spark.createDataFrame([(n % 2, f"e{n}") for n in range(4000)], "month int, id string")
    other = spark.createDataFrame([(n % 2, f"x{pick.random()}") for n in range(4000)], "month int, id string")
    halves = [bloom.filter_of(ids.filter(F.crc32("id") % 2 == i), ["month"], ["id"], 250) for i in (0, 1)]
    whole = bloom.merged(halves[0].unionByName(halves[1]), ["month"])
    assert bloom.may_contain(ids, whole, ["month"], ["id"], 250).count() == 4000
    assert bloom.may_contain(other, whole, ["month"], ["id"], 250).count() < 60
    moved = ids.withColumn("month", F.lit(7))
    assert bloom.may_contain(moved, whole, ["month"], ["id"], 250).count() == 0


def lines(spark, *given):
    """Validated messages: number of the event and hours after its time."""
    plain = ("payload", "round_no", "seq_no")  # sent as an object and as numbers, not as text
    text = [f'{{{",".join(chr(34) + k + chr(34) + ":" + (v if k in plain else chr(34) + v + chr(34)) for k, v in {**GOOD, "event_id": ID.format(n)}.items())}}}'
            for n, _ in given]
    frame = spark.createDataFrame([(t, h * 3_600_000) for t, (_, h) in zip(text, given)], "value string, ms long")
    return pl.received(frame.select("value", F.timestamp_millis(F.col("ms") + 1_704_067_200_100).alias("timestamp")))


def stored(spark, out):
    return sorted((int(r.event_id[-1]), r.late) for r in pl.raw_table(spark, out).read().collect())


def test_intake_sink_finds_repeats_and_loses_nothing(spark, tmp_path):
    """Copies that the state has forgotten are repeats; a batch done again is not its own repeat."""
    out, sink = str(tmp_path), pl.intake_sink(str(tmp_path))
    name = "sql.streaming.queryId"
    try:
        spark.sparkContext.setLocalProperty(name, "first")
        sink(lines(spark, (1, 0), (2, 0), (3, 5)), 0)
        sink(lines(spark, (1, 0), (2, 0), (3, 5)), 0)
        assert stored(spark, out) == [(1, False), (2, False), (3, True)]
        pl.raw_table(spark, out).compact()
        spark.sparkContext.setLocalProperty(name, "second")
        for _ in range(2):
            sink(lines(spark, (2, 6), (3, 6), (4, 6), (5, 0)), 0)
            assert stored(spark, out) == [(1, False), (2, False), (3, True), (4, True), (5, False)]
            again = spark.read.parquet(f"{out}/repeats")
            assert sorted(int(r.event_id[-1]) for r in again.collect()) == [2, 3]
    finally:
        spark.sparkContext.setLocalProperty(name, None)


def test_conservation_counts_every_row(spark, tmp_path):
    """A stream of two batches: copies, rejected lines (each counts) and old events."""
    given = [[(1, 0), (1, 0), (2, 0), (3, 3)], [(2, 0), (3, 3), (4, 9), (5, 0)]]
    for i, part in enumerate(given):
        frame = lines(spark, *part).select(
            F.to_json(F.struct("event_id", "match_id", "map_id", F.col("round_no").cast("long").alias("round_no"),
                               "ts_event", "ts_ingest", "type", "source",
                               F.col("seq_no").cast("long").alias("seq_no"), "trace_id", "event_schema_version", F.lit("{}").alias("payload"))).alias("value"),
            F.col("arrived").alias("timestamp"))
        frame = frame.withColumn("value", F.regexp_replace("value", '"payload":"\\{\\}"', '"payload":{}'))
        frame = frame.unionByName(spark.createDataFrame([("{broken",), ("{broken",)], "value string").withColumn(
            "timestamp", F.timestamp_millis(F.lit(1_704_067_200_100))))
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/slice={i}")
    pl.use_rocksdb(spark)
    messages = pl.file_messages(spark, f"{tmp_path}/in/slice=*", 1)
    query = pl.intake_stage(messages, f"{tmp_path}/out", {"availableNow": True})
    pl.drain(query)
    row = pl.conservation(spark, f"{tmp_path}/out", pl.observed(query)).first()
    assert row.asDict() == {"received": 12, "stored": 3, "late": 2, "quarantined": 4, "duplicate": 3}


def test_export_of_very_many_matches_has_few_files(spark, tmp_path):
    """As many files as tasks at most, a match's lines in order from file to file; one match by itself."""
    number = F.lpad((F.col("id") % 1500).cast("string"), 12, "0")
    given = {"match_id": F.concat(F.lit("m"), number), "event_id": F.concat(F.lit("e"), F.col("id").cast("string")),
             "seq_no": F.col("id"), "ts_event": F.timestamp_millis("id"), "ts_ingest": F.timestamp_millis("id")}
    raw = spark.range(6000).select(*(
        given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in sc.RAW.fields))
    store.export_matches(raw, f"{tmp_path}/all")
    written = sorted(os.path.join(at, f) for at, _, names in os.walk(f"{tmp_path}/all") for f in names if f.endswith(".txt"))
    assert 1 <= len(written) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = [(e["match_id"], e["seq_no"]) for f in written for e in map(json.loads, open(f))]
    assert places == sorted(places) and len(places) == 6000
    assert store.import_matches(spark, f"{tmp_path}/all").exceptAll(raw).count() == 0
    store.export_match(raw, "m000000000007", f"{tmp_path}/one")
    assert [r.seq_no for r in store.import_matches(spark, f"{tmp_path}/one").orderBy("seq_no").collect()] == [7, 1507, 3007, 4507]
