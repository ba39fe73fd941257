"""Writing tables and artefacts so that a retried or repeated write is harmless."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H


def append_blobs(blobs: DataFrame, path: str) -> None:
    """Content-addressed blobs by two-digit prefix; pass only absent ones."""
    blobs.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def publish_manifest(entries: DataFrame, path: str, version: int) -> None:
    """Write one manifest version whole; readers see it once its marker is there."""
    entries.write.mode("overwrite").parquet(f"{path}/version={version}")


def replace_buckets(anchors: DataFrame, path: str) -> None:
    """Replace exactly the (peer, bucket) partitions present in ``anchors``."""
    (
        anchors.withColumn("bucket", H.bucket_of(F.col("chunk_id")))
        .repartition("peer", "bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("peer", "bucket").parquet(path)
    )


def append_log(records: DataFrame, path: str) -> None:
    """Append label records as JSON lines."""
    records.write.mode("append").json(path)


def emptied(table: DataFrame, path: str) -> None:
    """Truncate: leave an empty table with the same columns."""
    table.limit(0).write.mode("overwrite").parquet(path)


def write_run(results: DataFrame, metrics: DataFrame, meta: dict, folder: str) -> None:
    """One evaluation run: results and metrics as JSON lines, meta and a report."""
    results.write.mode("overwrite").json(f"{folder}/results")
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    rows = metrics.where(F.col("eval_layer").isNull()).orderBy("arm").collect()     # one row per arm
    names = [c for c in metrics.columns if c not in ("arm", "eval_layer")]
    shown = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| metric | " + " | ".join(r.arm for r in rows) + " |", "|" + "---|" * (len(rows) + 1)]
    lines += [f"| {n} | " + " | ".join(shown(r[n]) for r in rows) + " |" for n in names]
    atomic_text(f"{folder}/meta.json", json.dumps(meta, indent=2, sort_keys=True) + "\n")
    atomic_text(f"{folder}/report.md", "\n".join(lines) + "\n")


def atomic_text(path: str, body: str) -> None:
    """Small driver-side artefact: write beside, then rename over."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(target.name + ".tmp")
    beside.write_text(body, encoding="utf-8")
    os.replace(beside, target)
