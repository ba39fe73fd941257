"""Order-free digests of large row sets: fingerprint and hash-bucket anchors.

The format is one at every size: rows fall into 16**DIGITS leaves by a hash of their
unique key, a leaf's digest is the hash of its items in key order, and digests fold
up sixteen at a time; a leaf without rows is left out.  Two sets that differ in one
row differ in one path of digests, however many rows they have.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H

#: Fixed by the format: hex digits of a leaf's path.
DIGITS = 4
BUCKETS = 16
EMPTY_BUCKET = hashlib.sha256(b"empty").hexdigest()


def _joined_hash(items: Column) -> Column:
    return F.sha2(F.array_join(items, "|"), 256)


def leaf_digests(rows: DataFrame) -> DataFrame:
    """(path, digest, n) per leaf of rows(key, item)."""
    path = F.substring(H.content_hash(F.col("key")), 1, DIGITS)
    return (
        rows.withColumn("path", path)
        .groupBy("path")
        .agg(
            F.sort_array(F.collect_list(F.struct("key", "item"))).alias("cells"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("path", _joined_hash(F.transform("cells", lambda c: c["item"])).alias("digest"), "n")
    )


def fold_up(level: DataFrame, stop: int) -> DataFrame:
    """Combine sixteen children per parent until paths have ``stop`` digits."""
    for width in range(DIGITS, stop, -1):
        level = (
            level.groupBy(F.substring("path", 1, width - 1).alias("path"))
            .agg(
                F.sort_array(F.collect_list(F.struct("path", "digest"))).alias("cells"),
                F.sum("n").alias("n"),
            )
            .select("path", _joined_hash(F.transform("cells", lambda c: c["digest"])).alias("digest"), "n")
        )
    return level


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """chunk_count and the first 16 hex digits of the digest of all ``id:hash`` rows."""
    rows = chunks.select(
        F.col("chunk_id").alias("key"),
        F.concat_ws(":", "chunk_id", "content_hash").alias("item"),
    )
    top = fold_up(leaf_digests(rows), 0)
    return top.select(
        F.col("n").alias("chunk_count"), F.substring("digest", 1, 16).alias("content_hash")
    )


def bucket_digests(anchors: DataFrame) -> DataFrame:
    """All 16 bucket digests; an empty bucket has a fixed digest."""
    rows = anchors.select(
        F.col("chunk_id").alias("key"),
        F.sha2(H.json_list(*[F.col(c) for c in ("chunk_id", "content_hash", "outlet", "title")]), 256).alias("item"),
    )
    top = fold_up(leaf_digests(rows), 1)
    filled = top.select(
        F.conv("path", 16, 10).cast("int").alias("bucket"), F.col("digest").alias("bucket_hash"), "n"
    )
    every = anchors.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(filled, "bucket", "left").select(
        "bucket",
        F.coalesce("bucket_hash", F.lit(EMPTY_BUCKET)).alias("bucket_hash"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def root_digest(buckets: DataFrame) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("bucket", "bucket_hash")))
    return buckets.agg(_joined_hash(F.transform(cells, lambda c: c["bucket_hash"])).alias("root_hash"))


def anchor_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What changes if ``local`` becomes ``remote``: added, changed, removed."""
    fields = ["content_hash", "outlet", "title"]
    mine = local.select("chunk_id", F.struct(*fields).alias("mine"))
    theirs = remote.select("chunk_id", F.struct(*fields).alias("theirs"))
    joined = mine.join(theirs, "chunk_id", "full_outer")
    change = (
        F.when(F.col("mine").isNull(), "added")
        .when(F.col("theirs").isNull(), "removed")
        .when(~F.col("mine").eqNullSafe(F.col("theirs")), "changed")
    )
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select(
        "chunk_id", "change", F.col("theirs.content_hash").alias("content_hash"),
        F.col("theirs.outlet").alias("outlet"), F.col("theirs.title").alias("title"),
    )


def mismatched_buckets(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Buckets whose digests differ; none when the roots agree."""
    mine = local.select("bucket", F.col("bucket_hash").alias("local_hash"))
    theirs = remote.select("bucket", F.col("bucket_hash").alias("remote_hash"))
    return mine.join(theirs, "bucket").where(F.col("local_hash") != F.col("remote_hash"))


def synced_anchors(local: DataFrame, remote: DataFrame, buckets: DataFrame) -> DataFrame:
    """``local`` with every listed bucket replaced by the remote rows."""
    stale = buckets.select("bucket")
    keep = local.withColumn("bucket", H.bucket_of(F.col("chunk_id"))).join(stale, "bucket", "left_anti")
    fresh = remote.withColumn("bucket", H.bucket_of(F.col("chunk_id"))).join(stale, "bucket", "left_semi")
    return keep.unionByName(fresh).drop("bucket")


def sync_cost(local_buckets: DataFrame, remote_buckets: DataFrame, remote: DataFrame) -> DataFrame:
    """Buckets and leaf rows one sync cycle would move, against all rows."""
    stale = mismatched_buckets(local_buckets, remote_buckets).select("bucket")
    sized = remote.select(
        H.bucket_of(F.col("chunk_id")).alias("bucket"),
        F.length(H.json_list(*[F.col(c) for c in ("chunk_id", "content_hash", "outlet", "title")])).alias("size"),
    )
    marked = sized.join(stale.withColumn("moved", F.lit(True)), "bucket", "left")
    return marked.agg(
        F.countDistinct(F.when(F.col("moved"), F.col("bucket"))).alias("buckets_synced"),
        F.coalesce(F.sum(F.when(F.col("moved"), F.col("size"))), F.lit(0)).alias("leaf_bytes_moved"),
        F.sum("size").alias("leaf_bytes_all"),
    )
