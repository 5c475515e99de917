"""The streaming jobs run to the end over the driver's tables.

Lines are put into three folders by arrival time and read file by file with
``availableNow``: several micro-batches with state carried across them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow import schema as sc
from matchflow.operators import rollups
from matchflow.plans import tables
from matchflow.session import cut, shared_path
from matchflow.sources import fixtures as fx
from matchflow.streaming import pipeline as pl

SLICES = 3
#: Files of a slice: this many at least, and one for so many events of the whole table.
FILES, FILE_EVENTS = 4, 50_000
NOW = {"availableNow": True}
_ran: dict[str, str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, job: Callable[[str], None]) -> str:
    """Folder a job wrote to; it runs once per application and data set."""
    key = f"{spark.sparkContext.applicationId}/{sf_dir}/{name}"
    if key not in _ran:
        out = shared_path(spark, "stream", str(len(_ran)), name)
        job(out)
        _ran[key] = out
    return _ran[key]


def _files(spark: SparkSession, sf_dir: str) -> int:
    """Files of each slice. A micro-batch reads one slice, so its tasks grow with the table; results do not depend on it."""
    return max(FILES, -(-tables.events(spark, sf_dir).count() // FILE_EVENTS))


def _write_slices(rows: DataFrame, time_ms, path: str, write: Callable[[DataFrame, str], None], slices: int = SLICES) -> None:
    """Slices of equal length in time, one written after the other."""
    timed = rows.withColumn("_ms", time_ms)
    low, high = timed.agg(F.min("_ms"), F.max("_ms")).first()
    step = (high - low) // slices + 1
    for i in range(slices):
        part = timed.filter(F.col("_ms").between(low + i * step, low + (i + 1) * step - 1)).drop("_ms")
        write(part, f"{path}/slice={i}")


def messages_folder(spark: SparkSession, sf_dir: str) -> str:
    """Received lines with the time of their intake, malformed ones and lines that are no JSON among them.

    Some valid events come for the first time three or four hours late, and
    some come again then.
    """

    def job(out: str) -> None:
        wire = fx.wire(fx.arrivals(tables.events(spark, sf_dir)), "event_no", "copy_no", "k")
        broken = F.when(F.col("seq_no") == "7", F.lit("{not json")).otherwise(fx.lines(wire))
        sound = (F.col("k") <= 90) & (F.col("event_no") % 41 != 0) & (F.col("seq_no") != "7") & (
            F.col("round_no").cast("int") <= sc.MAX_ROUND)
        rows = wire.select(
            broken.alias("value"), F.to_timestamp("ts_ingest").alias("timestamp"), "copy_no",
            F.when(sound, F.col("event_no") % 10).otherwise(-1).alias("digit"))
        rows = cut(rows)
        first = rows.filter(~F.col("digit").isin(7, 9))

        def message(df: DataFrame, hours: int = 0) -> DataFrame:
            return df.select("value", (F.col("timestamp") + F.expr(f"INTERVAL {hours} HOURS")).alias("timestamp"))

        files = _files(spark, sf_dir)
        write = lambda df, path: message(df).repartition(files).write.parquet(path)
        _write_slices(first, F.unix_millis("timestamp"), f"{out}/first", write)
        more = {"later": (3, [3, 7], [3]), "last": (4, [9], [3, 5, 7])}
        for name, (hours, new, again) in more.items():
            # Every copy of what is new, one copy of what comes again.
            of = F.col("digit").isin(new) | (F.col("digit").isin(again) & (F.col("copy_no") == 0))
            message(rows.filter(of), hours).repartition(files).write.parquet(f"{out}/{name}/slice={hours}")

    return _once(spark, sf_dir, "messages", job)


def raw_folder(spark: SparkSession, sf_dir: str) -> str:
    """Stored events in slices of sequence numbers, as earlier batches left them."""

    def job(out: str) -> None:
        rows = tables.events(spark, sf_dir).select(*sc.RAW.names)
        _write_slices(rows, F.col("seq_no"), out, lambda df, path: df.write.parquet(path))

    return _once(spark, sf_dir, "events", job)


def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = raw_folder(spark, sf_dir)
    return spark.readStream.schema(sc.RAW).option("maxFilesPerTrigger", 2).parquet(f"{path}/slice=*")


def intake(spark: SparkSession, sf_dir: str) -> str:
    """Two queries, one after the other: the second starts without the state of the first."""

    def job(out: str) -> None:
        pl.use_rocksdb(spark)
        folder = messages_folder(spark, sf_dir)
        read = None
        for name, slices in (("a", f"{folder}/{{first,later}}/slice=*"), ("b", f"{folder}/last/slice=*")):
            messages = pl.file_messages(spark, slices, _files(spark, sf_dir))
            query = pl.intake_stage(messages, out, NOW, f"{out}/_ckpt/{name}")
            pl.drain(query)
            rows = pl.observed(query)
            read = rows if read is None else read.unionByName(rows)
        read.write.parquet(f"{out}/observed")

    return _once(spark, sf_dir, "intake", job)


def live_folder(spark: SparkSession, sf_dir: str) -> str:
    """Events of all matches at once, in slices of intake time."""

    def job(out: str) -> None:
        rows = fx.live(tables.events(spark, sf_dir)).select(*sc.RAW.names)
        files = _files(spark, sf_dir)
        write = lambda df, path: df.repartition(files).write.parquet(path)
        _write_slices(rows, F.unix_millis("ts_ingest"), out, write, 4)

    return _once(spark, sf_dir, "live", job)


def sequence(spark: SparkSession, sf_dir: str) -> str:
    """Four micro-batches of live events, and one without rows for the timers left."""

    def job(out: str) -> None:
        pl.use_rocksdb(spark)
        rows = spark.readStream.schema(sc.RAW).option("maxFilesPerTrigger", _files(spark, sf_dir)).parquet(
            f"{live_folder(spark, sf_dir)}/slice=*")
        sink = pl.batch_sink((f"{out}/actions", lambda b: b))
        pl.drain(pl.start(pl.sequence_stage(rows), f"{out}/_ckpt", sink, trigger=NOW, timers=True))

    return _once(spark, sf_dir, "sequence", job)


def arrivals_folder(spark: SparkSession, sf_dir: str) -> str:
    """All events in slices of intake time, all matches at once; every 50th comes 5 seconds late."""

    def job(out: str) -> None:
        rows = tables.events(spark, sf_dir)
        live = fx.live(rows, lost=False).select("event_id", F.unix_millis("ts_ingest").alias("_at"))
        timed = cut(rows.select(*sc.RAW.names).join(live, "event_id"))
        files = _files(spark, sf_dir)
        write = lambda df, path: df.drop("_at").repartition(files).write.parquet(path)
        _write_slices(timed, F.col("_at"), out, write)

    return _once(spark, sf_dir, "arrivals", job)


def states(spark: SparkSession, sf_dir: str) -> str:
    """States and predictions from events in order of arrival."""

    def job(out: str) -> None:
        rows = spark.readStream.schema(sc.RAW).option("maxFilesPerTrigger", _files(spark, sf_dir)).parquet(
            f"{arrivals_folder(spark, sf_dir)}/slice=*")
        pl.drain(pl.state_stage(rows, out, NOW))

    return _once(spark, sf_dir, "states", job)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    def job(out: str) -> None:
        pl.drain(pl.start(raw_stream(spark, sf_dir), f"{out}/_ckpt", pl.timeline_sink(out), trigger=NOW))

    out = _once(spark, sf_dir, "timeline", job)
    return pl.merged_timeline(spark.read.parquet(f"{out}/timeline"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def job(out: str) -> None:
        sink = pl.round_partials_sink(out)
        pl.drain(pl.start(raw_stream(spark, sf_dir), f"{out}/_ckpt", sink, trigger=NOW))

    out = _once(spark, sf_dir, "rounds", job)
    return rollups.merged_rounds(spark.read.parquet(f"{out}/rounds"))
