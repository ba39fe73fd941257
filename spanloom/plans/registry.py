"""Named queries over the given tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables and the corpus roles they play."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Documents, spread out when the files hold fewer splits than cores.

        Text expressions are the dear part of most plans; a table with plenty of
        splits is read as it is, without a shuffle.
        """
        rows, cores = self.table("documents"), self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

    @cached_property
    def chunks(self) -> DataFrame:
        """One chunk per document; the outlet is its source."""
        return self.documents.select(
            F.col("doc_id").cast("string").alias("chunk_id"),
            F.col("doc_id").cast("string").alias("doc_id"),
            "text",
            F.col("source").alias("outlet"),
            F.col("lang").alias("eval_layer"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """One chunk per non-blank line of a document, id ``doc:line``."""
        return (
            self.documents
            .select("doc_id", F.col("source").alias("outlet"), "lang",
                    F.posexplode(F.split("text", "\n")).alias("position", "text"))
            .where(F.trim("text") != "")
            .withColumn("chunk_id", F.concat_ws(":", "doc_id", "position"))
        )

    @cached_property
    def queries(self) -> DataFrame:
        """Benchmark passages as the query set."""
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    @cached_property
    def vectors(self) -> DataFrame:
        """Vectors of chunks; a vector belongs to the document of the same number."""
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), "label"
        )

    @cached_property
    def vector_queries(self) -> DataFrame:
        """Queries with the vector that bears their number."""
        vectors = self.table("embeddings").select(
            F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
        )
        return self.queries.join(vectors, "query_id", "left")

    @cached_property
    def edges(self) -> DataFrame:
        """Edges from each document to the next: same language contradicts,
        otherwise the alphabetical order of the two languages picks the type."""
        here = self.table("documents").select("doc_id", "lang")
        ahead = here.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("next_lang"))
        return here.join(ahead, "doc_id").select(
            F.col("doc_id").cast("string").alias("src"),
            (F.col("doc_id") + 1).cast("string").alias("dst"),
            F.when(F.col("lang") == F.col("next_lang"), "contradicts")
            .when(F.col("lang") < F.col("next_lang"), "cites")
            .otherwise("supersedes")
            .alias("edge_type"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        """Conversation turns as chunks of a conversation."""
        return self.table("conversations").select(
            F.concat_ws(":", "conv_id", "turn").alias("chunk_id"),
            F.col("conv_id").cast("string").alias("doc_id"), "conv_id", "turn", "role", "text",
        )

    @cached_property
    def anchors(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("chunk_id"),
            H.content_hash(F.col("text")).alias("content_hash"),
            F.col("source").alias("outlet"),
            F.col("lang").alias("title"),
        )

    @cached_property
    def remote_anchors(self) -> DataFrame:
        """A peer's copy of the anchors: labelled toxic documents are gone there, low
        quality ones retitled, and every page added."""
        labels = self.table("labels").select(F.col("doc_id").cast("string").alias("chunk_id"), "quality", "toxic")
        kept = (
            self.anchors.join(labels, "chunk_id", "left")
            .where(F.coalesce("toxic", F.lit(0)) == 0)
            .withColumn("title", F.when(F.col("quality") == 0, F.concat("title", F.lit("*"))).otherwise(F.col("title")))
            .select("chunk_id", "content_hash", "outlet", "title")
        )
        added = self.table("pages").select(
            F.concat(F.lit("p"), "page_id").alias("chunk_id"),
            H.content_hash(F.col("html")).alias("content_hash"),
            F.lit("web").alias("outlet"), F.lit("page").alias("title"),
        )
        return kept.unionByName(added)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its checking SQL, if any."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
