"""A corpus store: content-addressed blobs, numbered manifests and a run log.

``root`` is a folder all executors share.  Blobs are written first and the
manifest last; a version counts once its success marker is there.  A run lost in
between leaves blobs that no manifest names, which the next run finds and
keeps, so running again is always safe.  One writer at a time is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import ingest as G
from . import writers as W

BLOBS = "content_hash string, content string, prefix string"
RUNS = "run_id string, step int, status string, version int, documents bigint, blobs_written bigint, deduped bigint"


class StoreError(ValueError):
    """A manifest version that is not there."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def _table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending; a folder without its marker is not one."""
    folder = f"{root}/manifests"
    if not _exists(spark, folder):
        return []
    fs, where = _path(spark, folder)
    names = [str(s.getPath().getName()) for s in fs.listStatus(where)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    return [n for n in numbers if _exists(spark, f"{folder}/version={n}/_SUCCESS")]


def next_version(spark: SparkSession, root: str) -> int:
    return max(versions(spark, root), default=0) + 1


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Entries of one version, by default the latest."""
    known = versions(spark, root)
    wanted = max(known, default=None) if version is None else version
    if wanted not in known:
        raise StoreError(f"no manifest version {'at all' if wanted is None else wanted} in {root}")
    return spark.read.parquet(f"{root}/manifests/version={wanted}").withColumn("version", F.lit(wanted))


def texts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(doc_id, version, text) of one version."""
    return G.texts_of_manifest(manifest(spark, root, version), _table(spark, f"{root}/blobs", BLOBS))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The last state of every run."""
    log = _table(spark, f"{root}/runs", RUNS, "json")
    return log.groupBy("run_id").agg(F.max_by(F.struct(*log.columns[1:]), "step").alias("last")).select("run_id", "last.*")


def _logged(spark: SparkSession, root: str, state: dict) -> None:
    rows = spark.createDataFrame([tuple(state.values())], RUNS).coalesce(1)
    rows.write.mode("overwrite").json(f"{root}/runs/run={state['run_id']}/at={state['step']}")


def ingest(docs: DataFrame, root: str, dry_run: bool = False, run_id: str | None = None) -> dict:
    """Store the texts of ``docs`` (doc_id, text) and publish them as the next version.

    Returns the run's state: status, version, documents, blobs_written and
    deduped (documents whose text another document or the store already has).
    Null texts are stored as empty ones.  A dry run counts and writes nothing.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fresh = G.new_blobs(docs, _table(spark, f"{root}/blobs", BLOBS))
    seen, new = docs.count(), fresh.count()
    state = {"run_id": run_id or str(uuid.uuid4()), "step": 0, "status": "dry run" if dry_run else "running",
             "version": next_version(spark, root), "documents": seen, "blobs_written": new, "deduped": seen - new}
    if dry_run:
        return state
    _logged(spark, root, state)
    try:
        W.append_blobs(fresh, f"{root}/blobs")
        entries = docs.withColumn("content_hash", H.content_hash(F.col("text")))
        W.publish_manifest(G.manifest_entries(entries, F.lit(state["version"])).drop("version"), f"{root}/manifests", state["version"])
    except Exception:
        _logged(spark, root, state | {"step": 1, "status": "failed"})
        raise
    state |= {"step": 1, "status": "completed"}
    _logged(spark, root, state)
    return state
