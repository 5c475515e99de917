"""Tables kept by month that are merged when read.

A table has a sorted base and deltas, both by month. A micro-batch writes its
rows as deltas under its own label, so a repeated batch replaces itself. A
reader takes, for months that have deltas, the row of highest version of each
key from base and deltas; other months are read as they are. Compaction writes
such a month anew as the next edition of its base and then removes the deltas
it has read; readers see the same rows before, between and after.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow.operators.dedup import RAW_KEY, dedup_latest


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; of a table these are its months, versions or batches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory() and "=" in s.getPath().getName()]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _value(folder: str) -> str:
    return folder.split("=", 1)[1]


@dataclass
class MergedTable:
    """A table in ``path``; ``schema`` without month.

    ``key`` names what a row is about, ``version`` orders its rows (ties by the
    later columns), ``sort`` is the order of files in the base.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: list[str] = field(default_factory=lambda: RAW_KEY)
    version: list[str] = field(default_factory=lambda: ["version", "ts_ingest"])
    sort: list[str] = field(default_factory=lambda: ["match_id", "seq_no"])

    def _delta(self) -> str:
        return f"{self.path}/delta"

    def write(self, rows: DataFrame, label: str) -> None:
        """Rows (with their month) of a batch; what the label held before is replaced."""
        (
            rows.select(*self.schema.names, "month", F.lit(label).alias("batch"))
            .hint("rebalance", "month")  # few files for a small batch, no skewed ones for a large one
            .sortWithinPartitions("month", *self.sort)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("month", "batch").parquet(self._delta())
        )

    def _read(self, paths: list[str], part: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("month", T.IntegerType()),
                               T.StructField(part, T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", paths[0].rsplit("/", 2)[0]).parquet(*paths)

    def labels(self, month: int) -> list[str]:
        """Batches that have rows of a month."""
        return sorted(_value(b) for b in _folders(self.spark, f"{self._delta()}/month={month}"))

    def open_months(self, months: list[int] | None = None) -> dict[int, list[str]]:
        """Months that have deltas, and their batches."""
        known = [int(_value(m)) for m in _folders(self.spark, self._delta())]
        wanted = {m: self.labels(m) for m in sorted(known) if months is None or m in months}
        return {m: batches for m, batches in wanted.items() if batches}

    def editions(self, month: int) -> list[int]:
        """Whole editions of a month's base, the newest last."""
        at = f"{self.path}/base/month={month}"
        whole = [e for e in _folders(self.spark, at) if exists(self.spark, f"{at}/{e}/_SUCCESS")]
        return sorted(int(_value(e)) for e in whole)

    def known_months(self) -> list[int]:
        """Months that have a base."""
        return sorted(int(_value(m)) for m in _folders(self.spark, f"{self.path}/base"))

    def base(self, months: list[int] | None = None) -> DataFrame:
        """The newest edition of each month."""
        newest = {m: self.editions(m)[-1:] for m in self.known_months() if months is None or m in months}
        paths = [f"{self.path}/base/month={m}/edition={e}" for m, last in newest.items() for e in last]
        return self._read(paths, "edition").drop("edition")

    def _batches(self, opened: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self._delta()}/month={m}/batch={label}" for m, batches in opened.items() for label in batches]
        return self._read(paths, "batch").drop("batch")

    def deltas(self, months: list[int] | None = None, but: str | None = None) -> DataFrame:
        """Rows of the batches, without those of one label."""
        opened = self.open_months(months)
        return self._batches({m: [label for label in batches if label != but] for m, batches in opened.items()})

    def read(self, months: list[int] | None = None) -> DataFrame:
        """All rows, each key once."""
        opened = self.open_months(months)
        base = self.base(months)
        if not opened:
            return base
        fresh = F.col("month").isin(list(opened))
        both = base.filter(fresh).unionByName(self._batches(opened))
        return base.filter(~fresh).unionByName(dedup_latest(both, [*self.key, "month"], self.version).select(*base.columns))

    def compact(self, months: list[int] | None = None, keep: int = 1, sweep: bool = True) -> None:
        """Fold the deltas of months into their base.

        ``keep`` older editions stay for readers still at work. Without
        ``sweep`` the deltas stay too, to be removed by a later run: they are
        rows the base has, so nothing changes for readers.
        """
        for month, batches in self.open_months(months).items():
            editions = self.editions(month)
            both = self.base([month]).unionByName(self._batches({month: batches}))
            once = dedup_latest(both, [*self.key, "month"], self.version).select(*self.schema.names)
            at = f"{self.path}/base/month={month}"
            number = (editions[-1] if editions else 0) + 1
            once.repartitionByRange(*self.sort).sortWithinPartitions(*self.sort).write.mode("overwrite").parquet(
                f"{at}/edition={number}")
            for label in batches if sweep else []:
                _remove(self.spark, f"{self._delta()}/month={month}/batch={label}")
            for old in editions[:max(0, len(editions) - keep)]:
                _remove(self.spark, f"{at}/edition={old}")
