"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.session import prepare, shared_path

#: Bytes of rows that are handed to a Python worker at once. Longer single rows come alone.
BATCH_BYTES = "4m"


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package and bound what a Python worker holds at a time."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def shared_uri(path: str) -> str:
    """Spark writes file:/x for local paths; a URI has two slashes more."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path if "://" in path else "file://" + path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read on from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """A-Z in lower case, cut at space, tab, newline, vertical tab, form feed and return."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def batches_of(rows: Iterable, size: int):
    """Lists of at most ``size`` items."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers outlive their tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library keeps house by itself
        pass


_remembered: list[tuple[str, Callable]] = []


def remembered(work: Callable) -> Callable:
    """Keeps a few results in a Python worker for as long as its tasks are of the same operator."""
    kept = functools.lru_cache(maxsize=4)(work)
    _remembered.append((work.__module__, kept))
    return kept


def forget_others(module: str) -> None:
    """Drop what other operators remember; a worker goes on with the next operator when theirs is through."""
    for of, kept in _remembered:
        if of != module:
            kept.cache_clear()


def tidy(work: Callable) -> Callable:
    """A function over the batches of a task that gives memory back when the task is through with it."""
    module = work.__module__

    @functools.wraps(work)
    def run(*args):
        forget_others(module)
        try:
            yield from work(*args)
        finally:
            give_back()

    return run


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: Bytes of input for each slice of a space of hashes.
SLICE_BYTES = 16 << 20


#: Sizes from here on mean that the planner does not know.
_UNKNOWN = 1 << 60


def planned_bytes(df: DataFrame) -> int:
    """Size of a table as the planner knows it; where it does not, its texts are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < _UNKNOWN:
        return size
    lengths = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(lengths), F.lit(0)).alias("n")).first()["n"]


def slices_of(df: DataFrame) -> int:
    """Slices of a space of hashes: in proportion to the input, the shuffle width at least."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, min(planned_bytes(df) // SLICE_BYTES, 20_000))
