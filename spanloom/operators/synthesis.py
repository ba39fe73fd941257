"""From ranked hits to an evidence bundle: edges, neighbours, pairs, mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checked_broadcast, durable
from . import retrieval as R

# Fixed values.
RELEVANCE_FLOOR = 0.13
LEXICAL_FLOOR = 0.15
LEXICAL_MIN_MATCHES = 2
CLOSE_SCORE_DELTA = 0.15
PAIR_BOOST = 0.05
BUNDLE_EDGE_TYPES = ("contradicts", "cites")

_EDGE = ["src", "dst", "edge_type"]


@dataclass
class Bundle:
    hits: DataFrame      # query_id, chunk_id, position, is_seed, ranks, rrf_score
    edges: DataFrame     # query_id, src, dst, edge_type
    pairs: DataFrame     # query_id, src, dst, edge_type
    mode: DataFrame      # query_id, mode
    texts: DataFrame     # chunk_id, text of every chunk that may be in a bundle


def edges_touching(seeds: DataFrame, edges: DataFrame, types=BUNDLE_EDGE_TYPES) -> DataFrame:
    """Edges with either endpoint among a query's seeds: two equi joins, not an OR."""
    wanted = edges.where(F.col("edge_type").isin(*types)).select(*_EDGE)
    ids = checked_broadcast(seeds.select("query_id", "chunk_id"))
    out = ids.join(wanted, ids.chunk_id == wanted.src).select("query_id", *_EDGE)
    into = ids.join(wanted, ids.chunk_id == wanted.dst).select("query_id", *_EDGE)
    return out.unionByName(into).distinct()


def neighbours(seeds: DataFrame, touching: DataFrame) -> DataFrame:
    """Other endpoints of the seeds' edges, minus the seeds."""
    ends = touching.select("query_id", F.explode(F.array("src", "dst")).alias("chunk_id")).distinct()
    return ends.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def lexically_relevant(text, query):
    """Fallback relevance of one side when no corpus IDF is at hand."""
    keys = T.keywords(query)
    needed = F.when(F.size(keys) >= 3, F.lit(LEXICAL_MIN_MATCHES)).otherwise(F.lit(1))
    return (T.best_sentence_score(text, keys) >= LEXICAL_FLOOR) & (
        T.best_sentence_hits(text, keys) >= needed
    )


def linked_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are members; contradictions need both ends relevant.

    ``members`` carries query_id, chunk_id and relevant.
    """
    side = members.select("query_id", "chunk_id", "relevant")
    left = side.withColumnsRenamed({"chunk_id": "src", "relevant": "src_ok"})
    right = side.withColumnsRenamed({"chunk_id": "dst", "relevant": "dst_ok"})
    return (
        edges.where(F.col("edge_type").isin(*BUNDLE_EDGE_TYPES))
        .join(left, ["query_id", "src"])
        .join(right, ["query_id", "dst"])
        .where((F.col("edge_type") != "contradicts") | (F.col("src_ok") & F.col("dst_ok")))
        .select("query_id", *_EDGE)
    )


def prioritised(members: DataFrame, pairs: DataFrame, k_max: int, delta: float) -> DataFrame:
    """Contradiction ends first (edge order), then seeds, then neighbours.

    The order key is a struct, so a query with a hub chunk is pruned to ``k_max``
    rows inside each task.
    """
    blank = F.lit("")
    ends = pairs.where(F.col("edge_type") == "contradicts").select(
        "query_id",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("chunk_id"), F.lit(0).alias("side")),
                F.struct(F.col("dst").alias("chunk_id"), F.lit(1).alias("side")),
            )
        ).alias("end"),
        "src", "dst",
    ).groupBy("query_id", F.col("end.chunk_id").alias("chunk_id")).agg(
        F.min(F.struct("src", "dst", "end.side")).alias("first_edge")
    )
    keyed = members.join(ends, ["query_id", "chunk_id"], "left").withColumn(
        "order_key",
        F.struct(
            F.when(F.col("first_edge").isNotNull(), 0).when(F.col("is_seed"), 1).otherwise(2).alias("tier"),
            F.coalesce("first_edge.src", blank).alias("src"),
            F.coalesce("first_edge.dst", blank).alias("dst"),
            F.coalesce("first_edge.side", F.lit(0)).alias("side"),
            F.coalesce("rank", F.lit(0)).alias("rank"),
            F.col("chunk_id").alias("id"),
        ),
    )
    kept = R.within_delta(keyed, delta)
    return R.top_per_query(kept, k_max, F.col("order_key"), rank="position").drop("order_key", "first_edge")


def boosted(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of any surviving pair gain a fixed score."""
    ends = pairs.select("query_id", F.explode(F.array("src", "dst")).alias("chunk_id")).distinct()
    return hits.join(ends.withColumn("paired", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn(
        "rrf_score",
        F.round(F.col("rrf_score") + F.when(F.col("paired"), F.lit(PAIR_BOOST)).otherwise(F.lit(0.0)), 9),
    ).drop("paired")


def mode_of(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    split = pairs.where(F.col("edge_type") == "contradicts").select("query_id").distinct()
    return queries.select("query_id").join(split.withColumn("hit", F.lit(True)), "query_id", "left").select(
        "query_id", F.when(F.col("hit"), "divergent").otherwise("convergent").alias("mode")
    )


def blunt_mode(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Mode without a query text: any contradiction, or close rivals elsewhere."""
    top = F.max("rrf_score").over(W.partitionBy("query_id"))
    close = (
        seeds.withColumn("near", (top - F.col("rrf_score")) <= CLOSE_SCORE_DELTA)
        .groupBy("query_id")
        .agg(
            (F.sum(F.col("near").cast("int")) >= 2).alias("rivals"),
            ((F.countDistinct("outlet") > 1) | (F.countDistinct("doc_id") > 1)).alias("spread"),
        )
    )
    split = edges.where(F.col("edge_type") == "contradicts").select("query_id").distinct()
    return close.join(split.withColumn("hit", F.lit(True)), "query_id", "left").select(
        "query_id",
        F.when(F.col("hit") | (F.col("rivals") & F.col("spread")), "divergent")
        .otherwise("convergent")
        .alias("mode"),
    )


def evidence_bundle(
    queries: DataFrame, chunks: DataFrame, edges: DataFrame, hits: DataFrame,
    k_max: int = 6, delta: float = R.SEED_DELTA, counts: DataFrame | None = None,
) -> Bundle:
    """Seeds -> floors -> rerank -> edges -> neighbours -> pairs -> bundle.

    Hits, seeds and members hold a few rows per query and feed several joins, so
    each is checkpointed instead of ranking the corpus again.  The texts of all
    hits and of whatever their edges reach are fetched in one scan.
    """
    asked = queries.select("query_id", "query")
    floored = durable(R.within_delta(hits, delta))
    reach = durable(edges_touching(floored, edges))
    ids = floored.select("chunk_id").unionByName(neighbours(floored, reach).select("chunk_id")).distinct()
    texts = durable(R.with_text(durable(ids), chunks))
    seeds = durable(
        R.drop_irrelevant(R.rerank(R.with_text(floored, texts).join(asked, "query_id")))
        .select("query_id", "chunk_id", "rank", "dense_rank", "sparse_rank", "rrf_score")
    )
    touching = durable(edges_touching(seeds, reach.select(*_EDGE).distinct()))
    near = neighbours(seeds, touching).join(texts.select("chunk_id"), "chunk_id", "left_semi")
    empty = F.lit(None).cast("int")
    members = seeds.withColumn("is_seed", F.lit(True)).unionByName(
        near.select(
            "query_id", "chunk_id", empty.alias("rank"), empty.alias("dense_rank"),
            empty.alias("sparse_rank"), F.lit(0.0).alias("rrf_score"), F.lit(False).alias("is_seed"),
        )
    )
    scores = R.relevance_of(
        R.with_text(members.select("query_id", "chunk_id"), texts),
        R.weighted_query_terms(asked, chunks, counts),
    )
    members = durable(
        members.join(scores, ["query_id", "chunk_id"], "left").withColumn(
            "relevant", F.coalesce("relevance", F.lit(0.0)) >= RELEVANCE_FLOOR
        )
    )
    ids = members.select("query_id", "chunk_id")
    usable = (
        touching.join(ids.withColumnRenamed("chunk_id", "src"), ["query_id", "src"], "left_semi")
        .join(ids.withColumnRenamed("chunk_id", "dst"), ["query_id", "dst"], "left_semi")
    )
    kept = durable(prioritised(members, linked_pairs(members, usable), k_max, delta))
    pairs = linked_pairs(kept, usable)
    return Bundle(boosted(kept, pairs), usable, pairs, mode_of(asked, pairs), texts)
