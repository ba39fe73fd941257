"""Peer routing summaries, kept per peer and fetched again when its anchor root changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

# What a peer announces and what is kept of it.
ROOT_SCHEMA = "node string, root_hash string, seq bigint"
SUMMARY_SCHEMA = ROOT_SCHEMA + ", centroid array<double>, terms map<string,double>, domains array<string>"


def root_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ROOT_SCHEMA).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def stale_peers(roots: DataFrame, kept: DataFrame) -> DataFrame:
    """(node, root_hash, seq) of peers never fetched, or whose latest root is newer
    than the kept one and differs; a late announcement changes nothing."""
    last = roots.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.max_by("root_hash", "seq").alias("root_hash"), F.max("seq").alias("seq"))
    known = kept.select("node", F.col("root_hash").alias("had"), F.col("seq").alias("at"))
    moved = (F.col("seq") > F.col("at")) & ~F.col("root_hash").eqNullSafe(F.col("had"))
    return last.join(known, "node", "left").where(F.col("at").isNull() | moved).select("node", "root_hash", "seq")


def kept_summaries(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """Each peer's latest summary, of batches before ``before`` if given."""
    rows = spark.read.schema(SUMMARY_SCHEMA + ", batch bigint").parquet(table)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    record = F.struct(*[F.col(c) for c in rows.columns if c not in ("node", "batch")])
    return rows.groupBy("node").agg(F.max_by(record, "seq").alias("last")).select("node", "last.*")


def keep_summaries(roots: DataFrame, fetch: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """Fetch what is stale once per batch of ``roots`` and store it under the batch's number.

    ``fetch(nodes)`` gives node, centroid, terms and domains of the listed peers;
    one that it leaves out stays stale.  A root is only kept along with its
    summary and a replayed batch overwrites itself, so a lost batch is made up for.
    """
    spark = roots.sparkSession
    spark.createDataFrame([], SUMMARY_SCHEMA).write.mode("ignore").parquet(f"{table}/batch=-1")

    def refresh(batch: DataFrame, number: int) -> None:
        stale = durable(stale_peers(batch, kept_summaries(batch.sparkSession, table, number)))
        if not stale.isEmpty():
            fresh = fetch(stale.select("node")).join(stale, "node")
            fresh.select("node", "root_hash", "seq", "centroid", "terms", "domains").write.mode("overwrite").parquet(
                f"{table}/batch={number}")

    return roots.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
