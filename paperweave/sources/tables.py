"""Pages, frontier log and result snapshots as parquet tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.operators import merge
from paperweave.schema import PAGE_SCHEMA, RESULT_SCHEMA, TRANSITION_SCHEMA
from paperweave.session import spread


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE_SCHEMA) -> DataFrame:
    """Fetched pages; a page without html is a failed fetch."""
    return spark.read.schema(schema).parquet(path)


def with_fetch_status(pages: DataFrame) -> DataFrame:
    """``fetched`` is false for a page whose html is NULL or blank."""
    return pages.withColumn(
        "fetched", F.coalesce(F.ltrim("html", F.lit(" \t\r\n")) != "", F.lit(False)))


_PAGE_FILE = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType())])


def page_files(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Pages of a folder of fetched files, ``page_id=.../url=.../`` with a file in each.

    A file is a page, whole and of any length; a blank one is a failed fetch, without
    html. ``stream`` takes files as they arrive, so many per batch. Files are found and
    read by Spark, wherever the folder is; the escapes of folder names are Spark's.
    """
    reader = spark.readStream if stream else spark.read
    if stream and files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.schema(_PAGE_FILE).format("text").option("wholetext", True).load(path)
    # the end of line that closes a text file is none of the page
    html = F.regexp_replace("value", r"\n\z", "")
    return files.select("page_id", "url", F.when(F.trim(html, F.lit(" \t\r\n")) != "", html).alias("html"))


#: Pages of a folder that a stream takes. Spark's driver holds some kB of every file in the folder of a stream
#: or written by one job, so a table of more pages is dealt to more folders, each with a stream of its own.
FOLDER_PAGES = 32768


def write_page_files(pages: DataFrame, path: str) -> None:
    """Add pages to a folder for :func:`page_files`, a file for each; what comes twice of a page is one file."""
    # a file takes far longer to make than its page to read, so no task is left with a whole row group
    spread(pages, "page_id", "url").select("html", "page_id", "url").write.mode("append").partitionBy(
        "page_id", "url").text(path)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_KEPT_LISTINGS = "spark.sql.hive.manageFilesourcePartitions"


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Meanwhile folders are listed by a few tasks for every core, and what was listed is not kept.

    For folders of very many, like those of :func:`page_files`: Spark takes a task per folder, up to
    10,000, whenever a stream starts, looks for files or takes a batch, and a task takes far longer
    to begin than a folder to list. The driver keeps up to 250 MB of what was listed, in case that the
    same relation is asked for again, which here it is not.
    """
    meanwhile = {_LISTING: str(4 * spark.sparkContext.defaultParallelism), _KEPT_LISTINGS: "false"}
    before = {key: spark.conf.get(key) for key in meanwhile}
    for key, value in meanwhile.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one when nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class TransitionLog:
    """Append-only log of link states; restarting a run never empties it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, TRANSITION_SCHEMA)

    def append(self, rows: DataFrame) -> None:
        rows.select(*TRANSITION_SCHEMA.names).write.mode("append").parquet(self.path)


_COMMIT = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("filled", T.BooleanType())])


class ResultTable:
    """Result rows in buckets by title, each with numbered versions.

    Records meet only rows of their title, so a merge reads and writes the
    buckets of its titles and leaves all others as they are. A version becomes
    visible by one appended commit, so readers never see a half-written table
    and a run that dies on the way leaves the old one in place. One writer at a
    time; folders of old versions stay until they are removed from outside.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("title"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _commits(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/commits", _COMMIT)

    def version(self) -> int:
        """Number of the last version; 0 when none was written yet."""
        return self._commits().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def current(self) -> dict[int, int]:
        """Version of every bucket that has rows; at most as many as there are buckets."""
        last = self._commits().groupBy("bucket").agg(F.max(F.struct("version", "filled")).alias("last"))
        return {r["bucket"]: r["last"]["version"] for r in last.collect() if r["last"]["filled"]}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = [f"{self.path}/rows/version={version}/bucket={bucket}"
                 for bucket, version in sorted(self.current().items()) if buckets is None or bucket in buckets]
        if not paths:
            return self.spark.createDataFrame([], RESULT_SCHEMA)
        return self.spark.read.schema(RESULT_SCHEMA).parquet(*paths)

    def replace(self, rows: DataFrame) -> int:
        """Write ``rows`` as the whole table; they may be read from it."""
        return self._write(rows, list(range(self.buckets)))

    def merge(self, records: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Write ``merge(rows, records)`` over the buckets of the records' titles."""
        touched = [r["bucket"] for r in records.select(self._bucket()).distinct().collect()]
        return self._write(merge(self.read(touched), records), touched)

    def _write(self, rows: DataFrame, buckets: list[int]) -> int:
        version = self.version() + 1
        folder = f"{self.path}/rows/version={version}"
        rows.select(*RESULT_SCHEMA.names, self._bucket()).hint("rebalance", "bucket") \
            .write.mode("overwrite").partitionBy("bucket").parquet(folder)
        schema = T.StructType([*RESULT_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
        written = {r["bucket"] for r in self.spark.read.schema(schema).parquet(folder)
                   .select("bucket").distinct().collect()}
        self.spark.createDataFrame([(version, b, b in written) for b in sorted(buckets)], _COMMIT).coalesce(1) \
            .write.mode("append").parquet(f"{self.path}/commits")
        return version


class BucketedResult:
    """Result rows as a Spark table in buckets by title.

    Records meet only rows of their title. Since the rows lie in buckets, sorted,
    a merge reads them where they are: only new records and what was folded from
    them are shuffled. A merge writes a new version beside the old one; the number
    of the last one is a folder of its own, written last, so a run that dies on the
    way leaves the old version. One writer at a time.

    A title has as many rows as publications that do not contain one another, not
    as many as records, so a bucket does not grow with the copies of a hot title.
    """

    #: Rows that agree in title and publication are in one bucket by title alone.
    _PLANNING = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, collation: str | None = None) -> None:
        self.spark, self.path, self.buckets, self.collation = spark, path.rstrip("/"), buckets, collation
        self.schema = T.StructType(RESULT_SCHEMA.fields + [
            T.StructField("title_key", T.StringType()), T.StructField("pub_key", T.StringType()),
            T.StructField("n_links", T.LongType())])

    def _versions(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/versions", T.StructType([
            T.StructField("version", T.LongType()), T.StructField("buckets", T.LongType())]))

    def version(self) -> int:
        """Number of the last version; 0 when none was written yet."""
        return self._versions().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _name(self, version: int) -> str:
        return f"paperweave_{hashlib.md5(self.path.encode()).hexdigest()}_{version}"

    def snapshot(self) -> DataFrame:
        """Rows with the keys they are met by; known to Spark as bucketed."""
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], self.schema)
        buckets = self._versions().where(F.col("version") == version).first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        # a session that did not write it does not know it yet
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(version)} ({columns}) USING parquet "
            f"CLUSTERED BY (title_key) SORTED BY (title_key, pub_key) INTO {buckets} BUCKETS "
            f"LOCATION '{self.path}/rows/version={version}'")
        return self.spark.table(self._name(version))

    def read(self) -> DataFrame:
        return self.snapshot().select(*RESULT_SCHEMA.names)

    def merged(self, records: DataFrame) -> DataFrame:
        """Rows after a merge, not written yet. Planned without a shuffle of the snapshot
        under the settings that :meth:`merge` plans with."""
        return merge.merge_into_snapshot(self.snapshot(), records, self.collation)

    def merge(self, records: DataFrame) -> int:
        before = {key: self.spark.conf.get(key) for key in self._PLANNING}
        for key, value in self._PLANNING.items():
            self.spark.conf.set(key, value)
        try:
            return self._write(self.merged(records))
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)

    def _write(self, rows: DataFrame) -> int:
        version = self.version() + 1
        name = self._name(version)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # of a run that died; its files are overwritten
        rows.select(*self.schema.names).write.mode("overwrite").format("parquet").bucketBy(
            self.buckets, "title_key").sortBy("title_key", "pub_key").option(
            "path", f"{self.path}/rows/version={version}").saveAsTable(name)
        self.spark.createDataFrame([(version, self.buckets)], self._versions().schema).coalesce(1) \
            .write.mode("append").parquet(f"{self.path}/versions")
        return version
