"""Decode traces (one JSON line per event) and the periodic anchor sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digests import bucket_digests, mismatched_buckets, synced_anchors

# Event names; a terminal event closes its request.
TERMINAL = ("final", "error")
TRACE_SCHEMA = """request_id string, seq bigint, event string, synthesis_mode string, manifest_hash string, chunk_count int,
  text string, span_type string, cited_chunk_ids array<string>"""


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(TRACE_SCHEMA).option("mode", "FAILFAST").json(folder)


def request_summaries(traces: DataFrame) -> DataFrame:
    """Per request: claims previewed, whether it is closed, whether the close came last."""
    terminal = F.col("event").isin(*TERMINAL)
    return traces.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum((F.col("event") == "claim_closed").cast("bigint")).alias("n_claims"),
        F.max(terminal).alias("closed"),
        (F.max("seq") == F.max(F.when(terminal, F.col("seq")))).alias("closed_last"),
        F.max_by("event", "seq").alias("last_event"),
    )


def sync_anchors(
    ticks: DataFrame, local: Callable[[], DataFrame], remote: Callable[[], DataFrame],
    store: Callable[[DataFrame, DataFrame], None], checkpoint: str,
):
    """Sync once per batch of ``ticks`` (a rate source on a cluster).

    ``store(rows, buckets)`` replaces the listed buckets.  A failing cycle is left
    to the next tick; nothing is stored when no bucket differs.
    """

    def cycle(_: DataFrame, number: int) -> None:
        mine, theirs = local(), remote()
        stale = mismatched_buckets(bucket_digests(mine), bucket_digests(theirs))
        if stale.limit(1).count():
            store(synced_anchors(mine, theirs, stale), stale)

    return ticks.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
