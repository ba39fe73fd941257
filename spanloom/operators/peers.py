"""Choosing which peer to ask: ranking, trust, routing and its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import RRF_K, dense_candidates

DEFAULT_TRUST = 1.0      # fixed value: weight of a domain nobody configured


def ranked_peers(queries: DataFrame, peers: DataFrame, centroids: DataFrame, terms: DataFrame) -> DataFrame:
    """Peer order per query: fused dense and term ranks, then peers without a
    summary in configured order.

    queries: query_id, query, query_vector.  peers: node, config_order (a node's
    configured list).  centroids: node, centroid.  terms: node, term, idf.
    """
    vectors = centroids.select(F.col("node").alias("chunk_id"), F.col("centroid").alias("vector"))
    near = dense_candidates(queries, vectors, max(1, peers.count())).withColumnRenamed("chunk_id", "node")
    asked = queries.select("query_id", F.explode(T.keywords(F.col("query"))).alias("term"))
    mass = asked.join(terms.select("node", "term", "idf"), "term").groupBy("query_id", "node").agg(
        F.round(F.sum("idf"), 9).alias("mass")
    )
    rows = near.join(mass, ["query_id", "node"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    per = W.partitionBy("query_id")
    fused = rows.withColumn("d", F.row_number().over(per.orderBy(F.col("similarity").desc(), "node"))).withColumn(
        "s", F.row_number().over(per.orderBy(F.col("mass").desc(), "node"))
    )
    score = F.round(F.lit(1.0) / (RRF_K + F.col("d")) + F.lit(1.0) / (RRF_K + F.col("s")), 9)
    silent = peers.join(centroids, "node", "left_anti").agg(
        F.sort_array(F.collect_list(F.struct("config_order", "node")))
    ).scalar()
    appended = queries.select("query_id", F.explode(silent).alias("p")).select(
        "query_id", F.col("p.node").alias("node"), F.lit(None).cast("double").alias("score"),
        F.col("p.config_order").alias("config_order"),
    )
    both = fused.select("query_id", "node", score.alias("score"), F.lit(0).cast("bigint").alias("config_order")).unionByName(
        appended.withColumn("config_order", F.col("config_order").cast("bigint"))
    )
    order = per.orderBy(F.col("score").desc_nulls_last(), "config_order", "node")
    return both.withColumn("rank", F.row_number().over(order)).select("query_id", "node", "score", "rank")


def trusted(peer_domains: Column, weights: Column, threshold: float) -> Column:
    """True unless a known domain's weight is below the threshold."""
    known = F.coalesce(peer_domains, F.array().cast("array<string>"))
    weight = lambda d: F.coalesce(F.try_element_at(weights, d), F.lit(DEFAULT_TRUST))
    return F.forall(known, lambda d: weight(d) >= threshold)


def trusted_order(ranked: DataFrame, domains: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Ranking without gated peers; the order of the rest is kept.

    domains: node, domains.  weights: node, domain, weight.
    """
    table = weights.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("domain", "weight"))).alias("weights"))
    rows = ranked.join(domains, "node", "left").join(table, "node", "left").withColumn(
        "weights", F.coalesce("weights", F.create_map().cast("map<string,double>"))
    )
    return rows.where(trusted(F.col("domains"), F.col("weights"), threshold)).drop("domains", "weights")


def routed(local: DataFrame, ranked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Answer locally, else ask peers in rank order until one answers.

    local: query_id, refused, reason.  outcomes: query_id, node, status, where
    status is "answer" or a refusal reason; a missing outcome is "unreachable".
    """
    asked = ranked.join(outcomes, ["query_id", "node"], "left").withColumn("status", F.coalesce("status", F.lit("unreachable")))
    hit = asked.groupBy("query_id").agg(F.min(F.when(F.col("status") == "answer", F.col("rank"))).alias("hit_rank"))
    tried = asked.join(hit, "query_id").where(F.col("hit_rank").isNull() | (F.col("rank") <= F.col("hit_rank")))
    per_query = tried.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "node", "status"))).alias("path")
    )
    went = local.where(F.col("refused")).join(per_query, "query_id", "left")
    path = F.coalesce("path", F.array().cast("array<struct<rank:int,node:string,status:string>>"))
    last = F.try_element_at(path, F.lit(-1))
    answered = F.coalesce(last["status"] == "answer", F.lit(False))
    remote = went.select(
        "query_id", (~answered).alias("refused"), (F.size(path) > 0).alias("was_routed"),
        F.when(answered, last["node"]).otherwise("local").alias("source_node"),
        F.transform(path, lambda p: p["node"]).alias("attempted"),
        F.concat(
            F.array(F.concat(F.lit("local="), F.coalesce("reason", F.lit("zero_cursors")))),
            F.transform(F.filter(path, lambda p: p["status"] != "answer"), lambda p: F.concat_ws("=", p["node"], p["status"])),
        ).alias("reasons"),
    )
    none = F.array().cast("array<string>")
    home = local.where(~F.col("refused")).select(
        "query_id", F.lit(False).alias("refused"), F.lit(False).alias("was_routed"), F.lit("local").alias("source_node"),
        none.alias("attempted"), none.alias("reasons"),
    )
    return home.unionByName(remote)


def routing_scores(outcomes: DataFrame) -> DataFrame:
    """Routing and selection metrics of outcomes(federation_class, expected_node,
    refused, was_routed, attempted, verified)."""
    cls = F.col("federation_class")
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    grounded = (cls == "peer_only") & F.col("was_routed") & ~F.col("refused")
    verified = grounded & F.col("verified")
    return outcomes.agg(
        F.count(F.lit(1)).alias("n_queries"),
        count((cls == "answerable") & F.col("was_routed")).alias("routing_false_positives"),
        ratio(count((cls == "peer_only") & F.col("was_routed")), count(cls == "peer_only")).alias("routing_recall"),
        ratio(count(verified), count(grounded)).alias("attribution_verified"),
        F.round(1 - F.try_divide(count(verified), count(grounded)), 6).alias("routed_fabrication_rate"),
        ratio(count((cls == "neither") & F.col("refused")), count(cls == "neither")).alias("honest_refusal_rate"),
        count((cls == "answerable") & ~F.col("refused") & ~F.col("was_routed")).alias("answered_locally"),
        ratio(count(grounded & (F.try_element_at("attempted", F.lit(1)) == F.col("expected_node"))), count(grounded)).alias("precision_at_1"),
        ratio(F.sum(F.when(grounded, F.size("attempted"))), count(grounded)).alias("avg_peers_tried"),
    )


def gated_contacts(outcomes: DataFrame, gated: str) -> DataFrame:
    return outcomes.agg(F.sum(F.array_contains("attempted", gated).cast("bigint")).alias("gated_peer_contacted"))
