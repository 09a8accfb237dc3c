"""Relational source and sink through Spark's JDBC data source.

Credentials and driver are passed as options and not kept here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession


def read_query(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int = 1,
               fetch_size: int = 10_000, **options: str) -> DataFrame:
    """Rows of a query. With a numeric ``partition_column`` it is read in parallel.

    The bounds only place the cuts: rows outside them are read as well.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    reader = reader.option("dbtable", f"({query}) t")
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
                  .option("numPartitions", partitions))
    return reader.options(**options).load()


def read_first(spark: SparkSession, url: str, query: str, **options: str) -> Row | None:
    """The first row of a query, or None."""
    return read_query(spark, url, query, **options).first()


def append_rows(rows: DataFrame, url: str, table: str, connections: int = 5,
                batch_size: int = 5_000, **options: str) -> None:
    """Insert rows in batches over at most ``connections`` connections."""
    (rows.write.format("jdbc").mode("append").option("url", url).option("dbtable", table)
     .option("numPartitions", connections).option("batchsize", batch_size)
     .options(**options).save())


def replace_rows(rows: DataFrame, url: str, table: str, connections: int = 5,
                 batch_size: int = 5_000, **options: str) -> None:
    """Put a new snapshot into a table, keeping its definition.

    JDBC writes cannot update single rows, so changed tables are written whole.
    ``rows`` must not be read from the same table.
    """
    (rows.write.format("jdbc").mode("overwrite").option("truncate", "true")
     .option("url", url).option("dbtable", table).option("numPartitions", connections)
     .option("batchsize", batch_size).options(**options).save())
