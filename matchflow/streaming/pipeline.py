"""Streaming jobs from received lines to predictions.

Stages hand over through tables in the shared folder. Every micro-batch is
written to its own ``batch=N`` folder with overwrite, so a batch repeated after
a failure replaces itself: the sinks are exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow import schema as sc
from matchflow.functions import bloom
from matchflow.operators import intake, rollups
from matchflow.session import cut
from matchflow.sources import store
from matchflow.sources.merged import MergedTable, exists
from matchflow.streaming import processors as proc
from matchflow.streaming.states import state_sink

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state that may outgrow memory, with changelog checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


# --- Sources ------------------------------------------------------------------


def file_lines(spark: SparkSession, path: str, max_files: int = sc.MAX_BATCH) -> DataFrame:
    """New files of JSON lines, taken in when the file was written; ``max_files`` bounds a micro-batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select("value", F.col("_metadata.file_modification_time").alias("timestamp"))


def file_messages(spark: SparkSession, path: str, max_files: int = sc.MAX_BATCH) -> DataFrame:
    """New files of messages: ``value`` and the ``timestamp`` of their intake, as Kafka has them."""
    schema = "value string, timestamp timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def kafka_lines(spark: SparkSession, servers: str, topics: str, max_offsets: int = 5_000_000) -> DataFrame:
    """Messages from Kafka (needs the connector on the class path)."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", topics)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return source.select(F.col("value").cast("string").alias("value"), "timestamp")


def received(messages: DataFrame, strict: bool = True) -> DataFrame:
    """Messages as validated wire events with their intake time ``arrived``, their JSON types checked. A line
    that is no JSON object has null fields, thus fails validation and ends in quarantine instead of the stream."""
    wire = intake.read_lines(messages.withColumnRenamed("timestamp", "arrived"), "arrived")
    return intake.validate(wire, strict=strict, typed=True, skew_ms=sc.MAX_SKEW_MS, sent="sent")


def once(validated: DataFrame, hours: int = sc.DEDUP_HOURS) -> DataFrame:
    """Valid events once each within two hours of the stream's own clock; rejected rows all.

    The state goes by the time of the micro-batch, not by event time: no row is
    ever behind that clock, so none is dropped as late, however old its event.
    What was read and how much of it was valid is observed as ``intake``.
    """
    bad = F.size("errors") > 0
    counted = validated.observe(
        "intake", F.count(F.lit(1)).alias("received"), F.count_if(~bad).alias("valid"))
    own = F.when(~bad, F.concat_ws("/", "match_id", "event_id")).otherwise(F.uuid())
    keyed = counted.withColumns({"_once": own, "_seen": F.current_timestamp()})
    return keyed.withWatermark("_seen", f"{hours} hours").dropDuplicatesWithinWatermark(["_once"]).drop("_once", "_seen")


# --- Sinks --------------------------------------------------------------------


def batch_sink(*outputs: tuple[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler that writes views of a batch to several tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist() if len(outputs) > 1 else batch
        for path, view in outputs:
            view(kept).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if len(outputs) > 1:
            kept.unpersist()

    return write


def start(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append",
          trigger: dict | None = None, timers: bool = False):
    """Start a query. ``timers`` lets a last batch without rows fire event-time timers at the end of the input."""
    trigger = trigger or {"processingTime": "1 second"}
    # A processing-time timeout asks for one more empty batch each time, so a
    # run that should end with its input must not have empty batches.
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = stream.sparkSession.conf.get(setting)
    stream.sparkSession.conf.set(setting, "false" if trigger.get("availableNow") and not timers else before)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(**trigger)
        .start()
    )
    stream.sparkSession.conf.set(setting, before)
    return query


def _same(batch: DataFrame) -> DataFrame:
    return batch


# --- Stages -------------------------------------------------------------------


#: An event that comes this long after its time may be a copy that the state has forgotten.
LATE_MS = sc.DEDUP_HOURS * 3_600_000 - sc.MAX_SKEW_MS
STORED = T.StructType([*sc.RAW.fields, T.StructField("late", T.BooleanType())])
IDS = ["match_id", "event_id"]


def raw_table(spark: SparkSession, out: str) -> MergedTable:
    return MergedTable(spark, f"{out}/raw", STORED)


def filters(spark: SparkSession, out: str) -> DataFrame:
    """Bloom filters of the stored ids by month, as the batches left them."""
    schema = "month int, block long, w0 long, w1 long, w2 long, w3 long, batch string"
    return spark.read.schema(schema).parquet(f"{out}/seen")


def repeats_of(late: DataFrame, out: str, label: str, months: list[int]) -> DataFrame:
    """Ids of late events that are stored already.

    The filter of their months leaves the possible ones; only these are looked
    up in the table. What the batch itself wrote before a failure does not count.
    """
    spark = late.sparkSession
    known = bloom.merged(filters(spark, out).filter(F.col("month").isin(months) & (F.col("batch") != label)), ["month"])
    table = raw_table(spark, out)
    stored = table.base(months).select("month", *IDS).unionByName(table.deltas(months, but=label).select("month", *IDS))
    return bloom.may_contain(late.select("month", *IDS), known, ["month"], IDS).join(stored, ["month", *IDS], "left_semi")


def intake_sink(out: str) -> Callable[[DataFrame, int], None]:
    """A batch to the raw table, the quarantine, and the repeats of events stored long ago.

    Every output of a batch lies under its label, made of the query's id and the
    number of the batch: repeated batches replace themselves, and a query that
    starts anew, with no state, adds to what others have stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        label = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        kept = batch.persist()
        valid, bad = intake.split(kept)
        age = F.unix_millis("arrived") - F.unix_millis("ts_event")
        typed = intake.typed_events(valid, "arrived").withColumn("late", age > LATE_MS)
        good = store.raw_columns(typed).select(*STORED.names, "month")

        def save(rows: DataFrame, name: str) -> None:
            rows.withColumn("batch", F.lit(label)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")

        save(intake.quarantine(bad.drop("arrived")), "quarantine")
        months = [r["month"] for r in good.filter("late").select("month").distinct().collect()]
        if months and exists(spark, f"{out}/seen"):
            again = repeats_of(good.filter("late"), out, label, months).distinct()
            again = cut(again)  # read before the batch writes
            fresh = good.join(again, ["month", *IDS], "left_anti")
            save(again, "repeats")
        else:
            fresh = good
        raw_table(spark, out).write(fresh, label)
        save(bloom.filter_of(fresh, ["month"], IDS), "seen")
        save(kept.agg(F.count_if(F.size("errors") == 0).alias("passed")), "ledger")
        kept.unpersist()

    return write


def intake_stage(messages: DataFrame, out: str, trigger: dict | None = None, checkpoint: str | None = None):
    """Received messages to the raw and the quarantine table, in one query that reads them once."""
    return start(once(received(messages)), checkpoint or f"{out}/_ckpt", intake_sink(out), trigger=trigger)


def observed(query) -> DataFrame:
    """What a query has read, batch by batch, from its recent progress."""
    rows = [(p.batchId, p.observedMetrics["intake"]["received"], p.observedMetrics["intake"]["valid"])
            for p in query.recentProgress if "intake" in p.observedMetrics]
    return SparkSession.active().createDataFrame(rows, "batch_id long, received long, valid long")


def conservation(spark: SparkSession, out: str, read: DataFrame) -> DataFrame:
    """What became of all rows: ``received = stored + late + quarantined + duplicate``, each counted by itself.

    ``read`` are the rows of ``observed``. Duplicates are what the state let not
    pass, and the repeats that the table showed.
    """
    def of(name: str, count: Column) -> Column:
        return _read_parts(spark, f"{out}/{name}").agg(count.alias("n")).scalar()

    rows = raw_table(spark, out).read()
    ever = read.agg(F.sum("received").alias("received"), F.sum("valid").alias("valid"))
    count = F.count(F.lit(1))
    return ever.select(
        "received",
        rows.agg(F.count_if(~F.col("late")).alias("n")).scalar().alias("stored"),
        rows.agg(F.count_if("late").alias("n")).scalar().alias("late"),
        of("quarantine", count).alias("quarantined"),
        (F.col("valid") - of("ledger", F.coalesce(F.sum("passed"), F.lit(0))) + of("repeats", count)).alias("duplicate"),
    )


_PARTS = {
    "ledger": "passed long, batch string",
    "repeats": "month int, match_id string, event_id string, batch string",
}


def _read_parts(spark: SparkSession, path: str) -> DataFrame:
    """An output kept by batch; empty where no batch had any."""
    name = path.rsplit("/", 1)[1]
    if name in _PARTS:
        reader = spark.read.schema(_PARTS[name])
        return reader.parquet(path) if exists(spark, path) else spark.createDataFrame([], _PARTS[name])
    return spark.read.parquet(path)


def sequence_stage(events: DataFrame, skew: str = "10 seconds") -> DataFrame:
    """Actions per event of the shards, in order of intake; what waits too long expires by timer.

    ``skew`` is how far the intake times of partitions may lie apart. The time
    column itself does not reach the processor, so no event is dropped as late.
    """
    clocked = events.withWatermark("ts_ingest", skew)
    slim = clocked.select(
        "match_id", "map_id", "event_id", "seq_no", F.unix_millis("ts_ingest").alias("received_ms"),
        (F.unix_millis("ts_ingest") - F.unix_millis("ts_event")).alias("age_ms"),
    )
    return slim.groupBy("match_id", "map_id").transformWithStateInPandas(
        proc.SequenceProcessor(), proc.SequenceProcessor.schema, "Append", "EventTime"
    )


def state_stage(events: DataFrame, out: str, trigger: dict | None = None, checkpoint: str | None = None):
    """Events, in whatever order, to states, updates and predictions."""
    return start(events, checkpoint or f"{out}/_ckpt", state_sink(out), trigger=trigger)


def timeline_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Events and kills per match and minute of each batch; ``merged_timeline`` adds them up.

    No state and no watermark: an event counts in its minute however late it
    comes.
    """
    return batch_sink((f"{out}/timeline", rollups.match_timeline))


def merged_timeline(partials: DataFrame) -> DataFrame:
    counts = [c for c in partials.columns if c not in ("match_id", "minute", "batch")]
    return rollups.merge_partials(partials, ["match_id", "minute"], counts, [], [])


def round_partials_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Partial round metrics of each batch; ``rollups.merged_rounds`` reads them."""
    return batch_sink((f"{out}/rounds", lambda batch: rollups.round_partials(batch, F.lit(0)).drop("batch")))


def drain(*queries) -> None:
    """Wait for queries that end by themselves (``availableNow``)."""
    for q in queries:
        q.awaitTermination()
