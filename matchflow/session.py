"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What a cluster job should run with. Nothing here grows with the data: the
# shuffle width is only a start value that adaptive execution merges or splits.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, app: str = "matchflow", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on, whoever built the session, and give
    the package to the Python workers of every executor."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="matchflow-code-"), "matchflow")
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, "matchflow"))
        _shipped.add(application)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local runs, tests) a folder of our own is made and named there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="matchflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([shared_folder(spark).rstrip("/"), spark.sparkContext.applicationId, *parts])


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read on from there.

    A table rather than ``checkpoint()``: later steps that need few columns
    read few columns, and a lost executor costs no recomputation.
    """
    path = shared_path(df.sparkSession, "steps", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
