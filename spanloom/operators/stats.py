"""Corpus statistics: postings, document frequency, IDF, centroids, top terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..session import durable

HEAVY_SHARE = 10_000


def postings(chunks: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """One row per (chunk_id, distinct term); ``keep`` narrows to its terms."""
    rows = chunks.select("chunk_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return rows if keep is None else rows.join(keep.select("term"), "term", "left_semi")


def chunk_count(chunks: DataFrame) -> Column:
    """Number of chunks as a scalar subquery, never a join."""
    return chunks.agg(F.count(F.lit(1))).scalar()


def smoothed_idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + F.lit(1.0)


def idf(chunks: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """term, df, idf over distinct terms per chunk (map-side combined)."""
    n = F.greatest(chunk_count(chunks), F.lit(1))
    return (
        postings(chunks, keep)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", smoothed_idf(F.col("df"), n))
    )


def rare_ceiling(n: Column) -> Column:
    """A term is rare up to this document frequency."""
    return F.greatest(F.lit(2).cast("bigint"), F.floor(n / 30))


def rare_terms(chunks: DataFrame, ceiling: int | None = None) -> DataFrame:
    bound = F.lit(ceiling) if ceiling is not None else rare_ceiling(chunk_count(chunks))
    return idf(chunks).where(F.col("df") <= bound)


def distinct_contents(chunks: DataFrame) -> DataFrame:
    """Fold exact copies: one row per text with its smallest id and copy count."""
    return (
        chunks.groupBy(F.sha2(F.col("text"), 256).alias("content_hash"))
        .agg(
            F.min("chunk_id").alias("chunk_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("text").alias("text"),
        )
    )


def joined_df(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Add each term's df (and what else ``df`` holds) to token rows without a hot shuffle key.

    At most HEAVY_SHARE terms can hold 1/HEAVY_SHARE of all postings each: those
    are broadcast, the others meet their df in a shuffle where no key is large.
    """
    df = durable(df)
    bound = df.agg(F.sum("df")).scalar() / HEAVY_SHARE
    heavy = F.broadcast(df.where(F.col("df") > bound).withColumnRenamed("df", "heavy_df"))
    marked = rows.join(heavy, "term", "left")
    common = marked.where(F.col("heavy_df").isNotNull()).withColumnRenamed("heavy_df", "df")
    more = [c for c in df.columns if c not in ("term", "df")]
    other = marked.where(F.col("heavy_df").isNull()).drop("heavy_df", *more).join(df.where(F.col("df") <= bound), "term")
    return common.unionByName(other)


def unit_mean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Unit-length mean vector per key; averages combine map-side per position."""
    means = (
        rows.select(key, F.posexplode(vector).alias("pos", "value"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("value").cast("double")).alias("mean"))
    )
    ordered = means.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("cells")
    )
    return ordered.select(
        key, V.unit(F.transform("cells", lambda c: c["mean"])).alias("centroid")
    )


def top_terms(chunks: DataFrame, key: str, top_n: int = 40) -> DataFrame:
    """The ``top_n`` highest-IDF terms of each node's own chunks, ties by term."""
    sizes = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    df = (
        chunks.select(key, F.explode(T.terms(F.col("text"))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    scored = df.join(sizes, key).withColumn("idf", smoothed_idf(F.col("df"), F.col("n")))
    order = W.partitionBy(key).orderBy(F.col("df"), F.col("term"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def domains(chunks: DataFrame, key: str, domain: str) -> DataFrame:
    return (
        chunks.where(F.col(domain) != "")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set(domain)).alias("domains"))
    )
