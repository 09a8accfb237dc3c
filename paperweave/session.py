"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state."
        "RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = "*", app: str = "paperweave", **conf) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="paperweave-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is
    unset and the master is local is a temporary folder taken instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = _local_folder()
    return f"{base.rstrip('/')}/paperweave/{name}-{uuid.uuid4().hex}"


#: Rows of a piece ahead of costly per-row work.
PIECE = 16384


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table out in pieces of equally many rows, as many for every core.

    For narrow rows ahead of costly per-row work: a table of few columns lies in few
    row groups, and a task would have the work of a whole one. Rows are counted first,
    which for a table without filter reads no rows. Rows that agree in ``keys`` stay in one piece.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rounds = -(-df.count() // (PIECE * cores))
    return df.repartition(cores * max(rounds, 1), *keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several branches of one job read the same intermediate result:
    it is computed once, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
