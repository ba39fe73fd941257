"""Session set-up and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Turn off the planner's reuse of a union's child partitioning.

    On Spark 4.1.2 an adaptive plan can coalesce the two sides of a union apart
    and still skip the shuffle above it, which leaves duplicates behind.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spanloom-ckpt-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan with a reliable checkpoint."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.  For long loops of joins: a checkpoint keeps
    its plan's size estimate, whose digits double with every step."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast once it is counted to hold at most ``rows``
    narrow rows; a larger one is returned as it is and joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
