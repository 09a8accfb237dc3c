"""Tables that batches write: one folder per batch, and state that is kept folded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.sources.tables import read_or_empty


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class BatchTable:
    """A table with one folder per batch number; a batch that runs again overwrites its own."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path = spark, path
        self.columns = schema
        self.schema = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def read(self, before: int | None = None, after: int | None = None) -> DataFrame:
        rows = read_or_empty(self.spark, self.path, self.schema)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if after is not None:
            rows = rows.where(F.col("batch") > after)
        return rows.drop("batch")

    def batches(self) -> list[int]:
        """Numbers of the batches that are there, from the names of their folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [str(f.getPath().getName()) for f in files.listStatus(path)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def last(self) -> int | None:
        """Number of the last batch written."""
        return max(self.batches(), default=None)

    def previous(self, batch: int) -> DataFrame:
        """Rows of the last batch before this one, and of no other."""
        earlier = [n for n in self.batches() if n < batch]
        if not earlier:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(self.folder(earlier[-1]))

    def write(self, rows: DataFrame, batch: int, **counts: Column) -> dict[str, int]:
        """Write a batch; ``counts`` are aggregates over its rows that the write itself gathers."""
        rows = rows.select(*self.columns.names)
        seen = Observation() if counts else None
        if seen is not None:
            rows = rows.observe(seen, *[value.alias(name) for name, value in counts.items()])
        rows.write.mode("overwrite").parquet(self.folder(batch))
        return {} if seen is None else {name: seen.get[name] or 0 for name in counts}

    def replace(self, rows: DataFrame, batch: int) -> None:
        """Write a batch that stands for all before it; the one before stays for a batch that runs again."""
        self.write(rows, batch)
        for earlier in [n for n in self.batches() if n < batch][:-1]:
            _remove(self.spark, self.folder(earlier))

    def keep(self, least: int) -> None:
        """Remove the batches before ``least``."""
        for batch in self.batches():
            if batch < least:
                _remove(self.spark, self.folder(batch))


class FoldedState:
    """The last row per key of an append-only log.

    The state up to some batch lies folded, one row per key, in buckets by ``near``,
    one of the keys; rows of later batches are the tail. Every so many batches the
    tail is folded in and removed. So a batch that asks for some keys reads their
    buckets and a tail of bounded length, however long the log has become.

    A batch folds only batches before it, and a batch that runs again finds what
    it found at first. ``folded`` is called with the folded rows and the number of
    the batch that folds, to derive what is kept beside them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], near: str,
                 order: str, every: int = 16, buckets: int = 64,
                 folded: Callable[[DataFrame, int], None] | None = None) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.near, self.order = keys, near, order
        self.every, self.buckets, self.folded = every, buckets, folded
        self.tail = BatchTable(spark, f"{path}/tail", schema)
        # the folder names batches that fold: it holds what was written before them
        self.base = BatchTable(spark, f"{path}/folded", T.StructType(
            schema.fields + [T.StructField("bucket", T.IntegerType())]))
        self.folds = BatchTable(spark, f"{path}/folds", T.StructType([T.StructField("n", T.LongType())]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.near), F.lit(self.buckets)).cast("int")

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [n for n in self.schema.names if n not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("_last")).select(
            *[n if n in self.keys else F.col("_last")[n].alias(n) for n in self.schema.names])

    def fold(self, before: int | None = None) -> int | None:
        """The batch that made the last whole fold, not after ``before``."""
        return max((n for n in self.folds.batches() if before is None or n <= before), default=None)

    def _based(self, fold: int | None, buckets: list[int] | None = None) -> DataFrame:
        if fold is None:
            return self.spark.createDataFrame([], self.schema)
        rows = read_or_empty(self.spark, self.base.folder(fold), self.base.columns)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*self.schema.names)

    def recent(self, before: int | None = None) -> DataFrame:
        """Rows of the tail."""
        fold = self.fold(before)
        return self.tail.read(before=before, after=None if fold is None else fold - 1)

    def read(self, before: int | None = None) -> DataFrame:
        """The state of all keys."""
        return self._last(self._based(self.fold(before)).unionByName(self.recent(before)))

    def of(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The state of the keys whose ``near`` occurs in ``wanted``.

        The numbers of their buckets, as many as there are buckets, go to the driver.
        """
        asked = wanted.select(self.near).distinct()
        buckets = [r[0] for r in asked.select(self._bucket()).distinct().collect()]
        rows = self._based(self.fold(before), buckets).unionByName(self.recent(before))
        return self._last(rows.join(asked, self.near, "left_semi"))

    def append(self, rows: DataFrame, batch: int, **counts: Column) -> dict[str, int]:
        """Write the rows of a batch, and fold those before it when it is time.

        What a caller still has to compute from earlier batches must be written before.
        """
        seen = self.tail.write(rows, batch, **counts)
        fold = self.fold(batch)
        tail = [n for n in self.tail.batches() if n < batch and (fold is None or n >= fold)]
        if len(tail) < self.every or fold == batch:
            return seen
        state = self._last(self._based(fold).unionByName(self.recent(batch)))
        state.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(self.base.folder(batch))
        if self.folded is not None:
            self.folded(self._based(batch), batch)
        self.folds.write(self.spark.range(1).select(F.lit(len(tail)).cast("long").alias("n")), batch)
        for table in (self.base, self.folds, self.tail):
            table.keep(batch)
        return seen
