"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.session import shared_folder

#: Rows of a table that may be broadcast, counted before the hint is given.
BROADCAST_ROWS = 200_000


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The table cuts the lineage, survives lost executors and is computed once.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """Hint a broadcast where the counted rows are within :data:`BROADCAST_ROWS`.

    ``df`` must be a stored table of narrow rows. Beyond the bound the join is
    an ordinary shuffle join with the same result.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str | object, n: int):
    """crc32 of the value written as text, modulo ``n``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % n


_BUCKET = 32_768          # bits of one of Spark's bitmaps
_FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame) -> DataFrame:
    """A bitmap of hashed ids, 2 MB at most however many there are: ``(bucket, bits)``.

    It only spares work: an id that is not in it is surely not in ``ids``.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS))
    return stored(ids.select(F.floor(slot / _BUCKET).alias("bucket"), F.pmod(slot, F.lit(_BUCKET)).alias("bit"))
                  .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")


def possible(df: DataFrame, bitmap: DataFrame, wanted: bool = True, key: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the filter, or those that surely are not."""
    slot = F.pmod(F.xxhash64(key), F.lit(_FILTER_BITS))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.pmod(F.col("__bit"), F.lit(8)).cast("int")) == 1, F.lit(False))
    joined = df.withColumn("__bucket", F.floor(slot / _BUCKET)).withColumn("__bit", F.pmod(slot, F.lit(_BUCKET))) \
        .join(F.broadcast(bitmap.withColumnRenamed("bucket", "__bucket")), "__bucket", "left")
    return joined.where(found if wanted else ~found).select(*df.columns)
