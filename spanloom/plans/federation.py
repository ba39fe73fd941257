"""Registered queries: peer summaries, ranking, trust and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peers as P
from ..operators import retrieval as R
from ..operators import stats
from ..session import durable
from . import corpus, search
from . import dialect as D
from .registry import query

THRESHOLD = 0.5


def node_chunks(t):
    """A node holds the documents whose vector bears its label."""
    labels = t.vectors.select("chunk_id", F.concat(F.lit("n"), "label").alias("node"))
    return t.chunks.join(labels, "chunk_id")


def peer_list(t):
    """Labels as configured peers, plus every source as a peer that never sent a
    summary; the number in its name is its configured place."""
    labels = t.table("embeddings").select(F.concat(F.lit("n"), "label").alias("node")).distinct()
    silent = t.table("documents").select(F.col("source").alias("node")).distinct()
    return labels.unionByName(silent).select(
        "node", F.regexp_extract("node", r"(\d+)$", 1).cast("bigint").alias("config_order")
    )


def centroids(t):
    return stats.unit_mean(t.vectors, "label", "vector").select(F.concat(F.lit("n"), "label").alias("node"), "centroid")


def summaries(t):
    return stats.top_terms(node_chunks(t), "node").select("node", "term", "idf")


def ranking(t):
    asked = t.vector_queries.where(F.col("query_vector").isNotNull())
    return P.ranked_peers(asked, peer_list(t), centroids(t), summaries(t))


PEERS = (
    D.CHUNKS, D.QUERYSET, corpus.CENTROIDS,
    "nodes AS (SELECT c.*, 'n' || e.label AS node FROM chunks c JOIN embeddings e ON e.vec_id::VARCHAR = c.chunk_id)",
    f"""nterms AS (
  SELECT node, term, ln((n + 1) / (df + 1)) + 1 AS idf FROM (
    SELECT u.node, u.term, u.df, s.n, row_number() OVER (PARTITION BY u.node ORDER BY u.df, u.term) AS rn
    FROM (SELECT node, term, count(*) AS df FROM (SELECT node, unnest({D.terms('text')}) AS term FROM nodes) z GROUP BY 1, 2) u
    JOIN (SELECT node, count(*) AS n FROM nodes GROUP BY 1) s ON s.node = u.node) x WHERE rn <= 40)""",
    f"""near AS (
  SELECT q.query_id, q.query, 'n' || c.label AS node,
         round(list_inner_product(v.embedding::DOUBLE[], c.centroid) / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))
               / sqrt(list_inner_product(c.centroid, c.centroid)), 6) AS similarity
  FROM queryset q JOIN embeddings v ON v.vec_id = q.query_id
  CROSS JOIN (SELECT label, list(value ORDER BY pos) AS centroid FROM centroids GROUP BY 1) c),
mass AS (
  SELECT a.query_id, t.node, round(sum(t.idf), 9) AS mass
  FROM (SELECT query_id, unnest({D.keywords('query')}) AS term FROM queryset) a JOIN nterms t ON t.term = a.term GROUP BY 1, 2),
fusedp AS (
  SELECT query_id, node, round(1.0::DOUBLE / (60 + d) + 1.0::DOUBLE / (60 + s), 9) AS score, 0 AS grp FROM (
    SELECT n.query_id, n.node, row_number() OVER (PARTITION BY n.query_id ORDER BY n.similarity DESC, n.node) AS d,
           row_number() OVER (PARTITION BY n.query_id ORDER BY coalesce(m.mass, 0) DESC, n.node) AS s
    FROM near n LEFT JOIN mass m ON m.query_id = n.query_id AND m.node = n.node) x),
ranked AS (
  SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN regexp_extract(node, '[0-9]+$')::INT END, node) AS rank FROM (
    SELECT query_id, node, score FROM fusedp
    UNION ALL SELECT q.query_id, s.source, NULL::DOUBLE FROM (SELECT DISTINCT query_id FROM near) q CROSS JOIN (SELECT DISTINCT source FROM documents) s) y)""",
)
TRUST = """nlangs AS (SELECT DISTINCT node, eval_layer FROM nodes),
weights AS (
  SELECT n.node, n.eval_layer AS domain, avg(l.quality)::DOUBLE AS weight
  FROM nodes n JOIN labels l ON l.doc_id::VARCHAR = n.chunk_id GROUP BY 1, 2),
gated AS (
  SELECT r.* FROM ranked r WHERE NOT EXISTS (
    SELECT 1 FROM nlangs x JOIN weights w ON w.node = x.node AND w.domain = x.eval_layer WHERE x.node = r.node AND w.weight < 0.75))"""


@query("rank_peers", D.with_(*PEERS) + "SELECT query_id, node, score, rank FROM ranked")
def rank_peers(t):
    return ranking(t)


@query("peer_domains", D.with_(D.CHUNKS, PEERS[3]) + """
SELECT node, string_agg(DISTINCT eval_layer, ',' ORDER BY eval_layer) AS domains FROM nodes GROUP BY 1""")
def peer_domains(t):
    return stats.domains(node_chunks(t), "node", "eval_layer").select("node", F.array_join("domains", ",").alias("domains"))


def gated_ranking(t):
    """A node's weight for a language is the quality rate of its labelled pages."""
    chunks = node_chunks(t)
    labels = t.table("labels").select(F.col("doc_id").cast("string").alias("chunk_id"), "quality")
    weights = chunks.join(labels, "chunk_id").groupBy("node", F.col("eval_layer").alias("domain")).agg(
        F.avg("quality").alias("weight")
    )
    return P.trusted_order(ranking(t), stats.domains(chunks, "node", "eval_layer"), weights, 0.75)


@query("trust_filter", D.with_(*PEERS, TRUST) + "SELECT query_id, node, rank FROM gated")
def trust_filter(t):
    return gated_ranking(t).select("query_id", "node", "rank")


# --- routing -----------------------------------------------------------------

ROUTE = (
    *PEERS, D.POSTINGS, D.IDF, search.ASKED, search.WEIGHTED, search.SENTS, search.RELEVANCE, TRUST,
    """local AS (
  SELECT q.query_id, coalesce(m.top, 0) < 0.6 AS refused, CASE WHEN coalesce(m.top, 0) < 0.3 THEN 'retrieval_confidence' END AS reason
  FROM queryset q LEFT JOIN (SELECT query_id, max(relevance) AS top FROM relevance GROUP BY 1) m ON m.query_id = q.query_id),
outcomes AS (
  SELECT r.query_id, n.node, CASE WHEN max(r.relevance) >= 0.35 THEN 'answer' ELSE 'zero_cursors' END AS status
  FROM relevance r JOIN nodes n ON n.chunk_id = r.chunk_id GROUP BY 1, 2),
tried AS (
  SELECT g.query_id, g.node, g.rank, coalesce(o.status, 'unreachable') AS status,
         min(CASE WHEN o.status = 'answer' THEN g.rank END) OVER (PARTITION BY g.query_id) AS hit
  FROM gated g LEFT JOIN outcomes o ON o.query_id = g.query_id AND o.node = g.node),
path AS (
  SELECT query_id, list(node ORDER BY rank) AS attempted, max(CASE WHEN status = 'answer' THEN node END) AS answered_by,
         list(node || '=' || status ORDER BY rank) FILTER (status <> 'answer') AS failed
  FROM tried WHERE hit IS NULL OR rank <= hit GROUP BY 1),
routes AS (
  SELECT l.query_id, l.refused AND p.answered_by IS NULL AS refused, l.refused AND p.query_id IS NOT NULL AS was_routed,
         CASE WHEN l.refused THEN coalesce(p.answered_by, 'local') ELSE 'local' END AS source_node,
         CASE WHEN l.refused THEN coalesce(p.attempted, []) ELSE [] END AS attempted,
         CASE WHEN l.refused THEN list_concat(['local=' || coalesce(l.reason, 'zero_cursors')], coalesce(p.failed, [])) ELSE [] END AS reasons
  FROM local l LEFT JOIN path p ON p.query_id = l.query_id)""",
)


def routes(t, gated=None):
    """Best relevance anywhere decides whether the local node answers; a node's
    own best relevance decides what it replies."""
    scores = R.relevance_everywhere(t.chunks, t.queries)
    top = scores.groupBy("query_id").agg(F.max("relevance").alias("top"))
    best = F.coalesce("top", F.lit(0.0))
    local = t.queries.join(top, "query_id", "left").select(
        "query_id", (best < 0.6).alias("refused"), F.when(best < 0.3, "retrieval_confidence").alias("reason")
    )
    nodes = node_chunks(t).select("chunk_id", "node")
    outcomes = scores.join(nodes, "chunk_id").groupBy("query_id", "node").agg(
        F.when(F.max("relevance") >= 0.35, "answer").otherwise("zero_cursors").alias("status")
    )
    # a row per query and node each, which the path reads twice
    return P.routed(local, durable(gated_ranking(t)) if gated is None else gated, durable(outcomes))


@query("route_first_success", D.with_(*ROUTE) + """
SELECT query_id, refused, was_routed, source_node, array_to_string(attempted, ',') AS attempted, array_to_string(reasons, ',') AS reasons FROM routes""")
def route_first_success(t):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return routes(t).select("query_id", "refused", "was_routed", "source_node", joined("attempted"), joined("reasons"))


CLASSES = """classes AS (
  SELECT r.*, CASE WHEN length(q.query) < 150 THEN 'answerable' WHEN length(q.query) < 220 THEN 'peer_only' ELSE 'neither' END AS federation_class,
         g.node AS expected_node, length(q.query) > 180 AS verified
  FROM routes r JOIN queryset q ON q.query_id = r.query_id LEFT JOIN gated g ON g.query_id = r.query_id AND g.rank = 1)"""


def outcome_rows(t):
    n = F.length("query")
    gated = durable(gated_ranking(t))
    kept = gated.where(F.col("rank") == 1).select("query_id", F.col("node").alias("expected_node"))
    return (
        routes(t, gated).join(t.queries, "query_id").join(kept, "query_id", "left")
        .withColumn("federation_class", F.when(n < 150, "answerable").when(n < 220, "peer_only").otherwise("neither"))
        .withColumn("verified", n > 180)
    )


@query("routing_scores", D.with_(*ROUTE, CLASSES) + """
SELECT count(*) AS n_queries, count(*) FILTER (federation_class = 'answerable' AND was_routed) AS routing_false_positives,
       round(count(*) FILTER (federation_class = 'peer_only' AND was_routed) / nullif(count(*) FILTER (federation_class = 'peer_only'), 0), 6) AS routing_recall,
       round(count(*) FILTER (grounded AND verified) / nullif(count(*) FILTER (grounded), 0), 6) AS attribution_verified,
       round(1 - count(*) FILTER (grounded AND verified) / nullif(count(*) FILTER (grounded), 0), 6) AS routed_fabrication_rate,
       round(count(*) FILTER (federation_class = 'neither' AND refused) / nullif(count(*) FILTER (federation_class = 'neither'), 0), 6) AS honest_refusal_rate,
       count(*) FILTER (federation_class = 'answerable' AND NOT refused AND NOT was_routed) AS answered_locally,
       round(count(*) FILTER (grounded AND attempted[1] = expected_node) / nullif(count(*) FILTER (grounded), 0), 6) AS precision_at_1,
       round(sum(CASE WHEN grounded THEN len(attempted) END) / nullif(count(*) FILTER (grounded), 0), 6) AS avg_peers_tried
FROM (SELECT *, federation_class = 'peer_only' AND was_routed AND NOT refused AS grounded FROM classes) x""")
def routing_scores(t):
    return P.routing_scores(outcome_rows(t))


@query("gated_contacts", D.with_(*ROUTE) + "SELECT count(*) FILTER (list_contains(attempted, 'n3')) AS gated_peer_contacted FROM routes")
def gated_contacts(t):
    return P.gated_contacts(routes(t), "n3")
