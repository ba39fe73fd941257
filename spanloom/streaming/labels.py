"""Label records arriving as a stream, folded latest-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import folded, pair_of
from ..sources.readers import LABEL_SCHEMA, as_labels


def label_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LABEL_SCHEMA).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return as_labels(reader.json(folder))


def folding(stream: DataFrame) -> DataFrame:
    """Running fold as a stateful aggregate (update or complete mode).

    A maximum by (ts, seq) does not care in which order records come, so no
    watermark is needed for the right answer; the state is one row per pair.
    """
    record = F.struct(*[F.col(c) for c in stream.columns])
    return (
        stream.groupBy(pair_of(F.col("src"), F.col("dst")).alias("pair"))
        .agg(F.max_by(record, F.struct("ts", "seq")).alias("record"))
        .select("record.*")
    )


def fold_to_table(stream: DataFrame, table: str, checkpoint: str):
    """Write each batch's own fold under its batch number.

    A replayed batch overwrites itself; folding the table gives the current
    labels, and ``compact`` folds it down when it has grown.
    """

    def write(batch: DataFrame, number: int) -> None:
        folded(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_labels(spark: SparkSession, table: str) -> DataFrame:
    return folded(spark.read.parquet(table).drop("batch"))


def compact(spark: SparkSession, table: str, target: str) -> None:
    current_labels(spark, table).write.mode("overwrite").parquet(f"{target}/batch=0")
