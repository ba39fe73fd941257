"""Registered queries: relevance, hybrid retrieval, evidence bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import synthesis as S
from ..session import durable
from . import dialect as D
from .registry import query

K = 15
K_SEED = 5

# --- shared CTEs -------------------------------------------------------------

ASKED = f"asked AS (SELECT query_id, unnest({D.folded_keywords('query')}) AS term FROM queryset)"
WEIGHTED = """weighted AS (
  SELECT a.query_id, a.term, i.idf, sum(i.idf) OVER (PARTITION BY a.query_id) AS mass
  FROM asked a JOIN idf i ON i.term = a.term)"""
SENTS = f"""sents AS (
  SELECT chunk_id, i AS sentence, unnest({D.terms('parts[i]')}) AS term
  FROM (SELECT chunk_id, {D.sentences('text')} AS parts FROM chunks) c, generate_series(1, len(parts)) g(i))"""
RELEVANCE = """relevance AS (
  SELECT query_id, chunk_id, round(max(share), 6) AS relevance FROM (
    SELECT w.query_id, s.chunk_id, s.sentence, sum(w.idf) / max(w.mass) AS share
    FROM sents s JOIN weighted w ON w.term = s.term GROUP BY 1, 2, 3) x GROUP BY 1, 2)"""
RELEVANCE_ALL = (D.CHUNKS, D.QUERYSET, D.POSTINGS, D.IDF, ASKED, WEIGHTED, SENTS, RELEVANCE)

DENSE = """sims AS (
  SELECT q.query_id, v.vec_id::VARCHAR AS chunk_id,
         round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])
               / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
               / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS similarity
  FROM (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id) q, embeddings v),
dense AS (
  SELECT * FROM (SELECT query_id, chunk_id, similarity,
                        row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS dense_rank
                 FROM sims) x WHERE dense_rank <= {k})"""


def lexical(require_all: bool, name: str = "sparse") -> str:
    having = "HAVING count(*) = max(n.n_terms)" if require_all else ""
    return f"""tf AS (
  SELECT chunk_id, term, count(*) AS tf FROM (
    SELECT chunk_id, unnest({D.folded_words('text')}) AS term FROM chunks) u
  WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
{name} AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS sparse_rank
    FROM (SELECT a.query_id, t.chunk_id, round(sum(i.idf * (ln(t.tf) + 1)), 6) AS score
          FROM asked a JOIN tf t ON t.term = a.term JOIN idf i ON i.term = a.term
          JOIN (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY 1) n ON n.query_id = a.query_id
          GROUP BY 1, 2 {having}) s) x WHERE sparse_rank <= {{k}})"""


FUSED = """fused AS (
  SELECT query_id, chunk_id, dense_rank, sparse_rank, rrf_score,
         row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank
  FROM (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id,
               dense_rank, sparse_rank,
               round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9) AS rrf_score
        FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id) f)"""


def hits_ctes(k: int, require_all: bool) -> tuple[str, ...]:
    return (
        D.CHUNKS, D.QUERYSET, D.POSTINGS, D.IDF, ASKED, DENSE.format(k=k),
        lexical(require_all).format(k=k), FUSED,
        f"hits AS (SELECT * FROM fused WHERE rank <= {k})",
    )


SEEDS = f"""scored AS (
  SELECT h.*, round(CASE WHEN len(q.keys) = 0 THEN 0.0 ELSE
           {D.best_sentence_hits('c.text', 'q.keys')}::DOUBLE / len(q.keys) END, 9) AS sentence_score,
         len(q.keys) AS n_keys
  FROM (SELECT *, max(rrf_score) OVER (PARTITION BY query_id) AS best FROM hits) h
  JOIN chunks c ON c.chunk_id = h.chunk_id
  JOIN (SELECT query_id, {D.keywords('query')} AS keys FROM queryset) q ON q.query_id = h.query_id
  WHERE h.rrf_score >= h.best - 0.25),
reranked AS (
  SELECT query_id, chunk_id, dense_rank, sparse_rank, rrf_score, sentence_score,
         max(sentence_score) OVER (PARTITION BY query_id) AS top_sentence,
         row_number() OVER (PARTITION BY query_id ORDER BY sentence_score DESC,
                            CASE WHEN n_keys = 0 THEN rank END, chunk_id) AS rank
  FROM scored),
seeds AS (SELECT * FROM reranked WHERE sentence_score > 0 OR top_sentence <= 0)"""
TOUCHING = """touching AS (
  SELECT DISTINCT s.query_id, e.src, e.dst, e.edge_type FROM seeds s JOIN edges e ON s.chunk_id IN (e.src, e.dst)
  WHERE e.edge_type IN ('contradicts', 'cites'))"""
MEMBERS = """members AS (
  SELECT m.*, coalesce(r.relevance, 0) >= 0.13 AS relevant FROM (
    SELECT query_id, chunk_id, rank, dense_rank, sparse_rank, rrf_score, true AS is_seed FROM seeds
    UNION ALL
    SELECT DISTINCT t.query_id, t.cid, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0.0::DOUBLE, false FROM (
      SELECT query_id, src AS cid FROM touching UNION SELECT query_id, dst FROM touching) t
    WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = t.query_id AND s.chunk_id = t.cid)) m
  LEFT JOIN relevance r ON r.query_id = m.query_id AND r.chunk_id = m.chunk_id)"""


def pairs_cte(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT t.query_id, t.src, t.dst, t.edge_type FROM touching t
  JOIN {source} a ON a.query_id = t.query_id AND a.chunk_id = t.src
  JOIN {source} b ON b.query_id = t.query_id AND b.chunk_id = t.dst
  WHERE t.edge_type <> 'contradicts' OR (a.relevant AND b.relevant))"""


KEPT = """ends AS (
  SELECT query_id, chunk_id, min({'s': src, 'd': dst, 'side': side}) AS first_edge FROM (
    SELECT query_id, src AS chunk_id, src, dst, 0 AS side FROM pairs0 WHERE edge_type = 'contradicts'
    UNION ALL SELECT query_id, dst, src, dst, 1 FROM pairs0 WHERE edge_type = 'contradicts') u GROUP BY 1, 2),
kept AS (
  SELECT * FROM (
    SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY
             CASE WHEN e.first_edge IS NOT NULL THEN 0 WHEN m.is_seed THEN 1 ELSE 2 END,
             coalesce(e.first_edge.s, ''), coalesce(e.first_edge.d, ''), coalesce(e.first_edge.side, 0),
             coalesce(m.rank, 0), m.chunk_id) AS position
    FROM (SELECT *, max(rrf_score) OVER (PARTITION BY query_id) AS best FROM members) m
    LEFT JOIN ends e ON e.query_id = m.query_id AND e.chunk_id = m.chunk_id
    WHERE m.rrf_score >= m.best - 0.25) x WHERE position <= 6)"""
BUNDLE = (
    *hits_ctes(K_SEED, False), WEIGHTED, SENTS, RELEVANCE, SEEDS, D.EDGES, TOUCHING, MEMBERS,
    pairs_cte("pairs0", "members"), KEPT, pairs_cte("pairs", "kept"),
    """bundle AS (
  SELECT k.query_id, k.chunk_id, k.position, k.is_seed, k.dense_rank, k.sparse_rank,
         round(k.rrf_score + CASE WHEN p.chunk_id IS NOT NULL THEN 0.05 ELSE 0 END, 9) AS rrf_score
  FROM kept k LEFT JOIN (SELECT query_id, src AS chunk_id FROM pairs UNION SELECT query_id, dst FROM pairs) p
    ON p.query_id = k.query_id AND p.chunk_id = k.chunk_id)""",
)


# --- relevance ---------------------------------------------------------------


@query("idf_relevance_topk", D.with_(*RELEVANCE_ALL) + f"""
SELECT query_id, chunk_id, relevance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS rank FROM relevance) x
WHERE rank <= {K}""")
def idf_relevance_topk(t):
    scored = R.relevance_everywhere(t.chunks, t.queries)
    return R.top_per_query(scored, K, F.col("relevance").desc(), F.col("chunk_id"))


@query("divergence_relevant", D.with_(*RELEVANCE_ALL) + """
SELECT query_id, count(*) AS n_relevant FROM relevance WHERE relevance >= 0.13 GROUP BY 1""")
def divergence_relevant(t):
    scored = R.relevance_everywhere(t.chunks, t.queries)
    return scored.where(F.col("relevance") >= S.RELEVANCE_FLOOR).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_relevant")
    )


def _next_turns(t):
    """Each turn with the turn that answers it."""
    later = t.turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return t.turns.join(later, ["conv_id", "turn"])


REPLIES = """replies AS (
  SELECT a.conv_id || ':' || a.turn AS chunk_id, a.text, b.text AS reply
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query("sentence_scores", D.with_(REPLIES) + f"""
SELECT chunk_id, hits, round(CASE WHEN n = 0 THEN 0.0 ELSE hits::DOUBLE / n END, 9) AS score, shares,
       n > 0 AND hits::DOUBLE / n >= 0.15 AND hits >= CASE WHEN n >= 3 THEN 2 ELSE 1 END AS lexical_ok
FROM (SELECT chunk_id, len({D.keywords('text')}) AS n,
             CASE WHEN len({D.keywords('text')}) = 0 THEN 0 ELSE {D.best_sentence_hits('reply', D.keywords('text'))} END AS hits,
             len(list_intersect({D.folded_keywords('text')}, {D.terms('reply')})) > 0 AS shares FROM replies) x""")
def sentence_scores(t):
    """How well each reply covers the keywords of the turn before it."""
    keys = T.keywords(F.col("text"))
    return _next_turns(t).select(
        "chunk_id",
        T.best_sentence_hits(F.col("reply"), keys).alias("hits"),
        F.round(T.best_sentence_score(F.col("reply"), keys), 9).alias("score"),
        T.shares_keyword(F.col("reply"), F.col("text")).alias("shares"),
        S.lexically_relevant(F.col("reply"), F.col("text")).alias("lexical_ok"),
    )


# --- retrieval ---------------------------------------------------------------


@query("dense_topk", D.with_(DENSE.format(k=K)) + "SELECT query_id, chunk_id, similarity, dense_rank FROM dense")
def dense_topk(t):
    return R.dense_leg(t.vector_queries, t.vectors, K)


@query("dense_topk_blocked", D.with_(DENSE.format(k=K)) + "SELECT query_id, chunk_id, similarity, dense_rank FROM dense")
def dense_topk_blocked(t):
    asked = t.vector_queries.where(F.col("query_vector").isNotNull())
    near = R.dense_candidates_blocked(asked, t.vectors, K)
    return R.top_per_query(near, K, F.col("similarity").desc(), F.col("chunk_id"), rank="dense_rank")


def _lexical_oracle(require_all):
    return D.with_(D.CHUNKS, D.QUERYSET, D.POSTINGS, D.IDF, ASKED, lexical(require_all).format(k=K)) + (
        "SELECT query_id, chunk_id, score, sparse_rank FROM sparse"
    )


@query("lexical_topk_all", _lexical_oracle(True))
def lexical_topk_all(t):
    return R.lexical_leg(t.queries, t.chunks, K, require_all=True)


@query("lexical_topk_any", _lexical_oracle(False))
def lexical_topk_any(t):
    return R.lexical_leg(t.queries, t.chunks, K, require_all=False)


@query("rrf_fusion", D.with_(*hits_ctes(K, True)) + "SELECT query_id, chunk_id, dense_rank, sparse_rank, rrf_score, rank FROM hits")
def rrf_fusion(t):
    return R.retrieve(t.vector_queries, t.chunks, t.vectors, K)


@query("filtered_retrieval", D.with_(
    D.CHUNKS.replace("FROM documents)", "FROM documents WHERE lang = 'en')"), D.QUERYSET, D.POSTINGS, D.IDF, ASKED,
    lexical(True).format(k=K)) + "SELECT query_id, chunk_id, score, sparse_rank FROM sparse")
def filtered_retrieval(t):
    """The equality filter narrows the population before ranking."""
    return R.lexical_leg(t.queries, R.chunk_filter(t.chunks, eval_layer="en"), K)


@query("confidence_status", D.with_(*hits_ctes(K, True)) + """
SELECT q.query_id, coalesce(top_score, 0.0) AS top_score,
       CASE WHEN top_score IS NULL OR top_score < 0.020 THEN 'low_confidence' END AS refusal_reason
FROM queryset q LEFT JOIN (SELECT query_id, max(rrf_score) AS top_score FROM hits GROUP BY 1) h ON h.query_id = q.query_id""")
def confidence_status(t):
    hits = R.retrieve(t.vector_queries, t.chunks, t.vectors, K)
    return R.confidence_status(t.queries, hits, floor=0.020)


@query("relevance_floor", D.with_(*hits_ctes(K, False)) + """
SELECT query_id, chunk_id, rrf_score FROM (
  SELECT *, max(rrf_score) OVER (PARTITION BY query_id) AS best FROM hits) x WHERE rrf_score >= best - 0.010""")
def relevance_floor(t):
    hits = R.retrieve(t.vector_queries, t.chunks, t.vectors, K, require_all=False)
    return R.within_delta(hits, 0.010).select("query_id", "chunk_id", "rrf_score")


@query("reranked_seeds", D.with_(*hits_ctes(K_SEED, False), SEEDS) + "SELECT query_id, chunk_id, sentence_score, rank FROM seeds")
def reranked_seeds(t, hits=None):
    hits = durable(_seed_hits(t)) if hits is None else hits      # a few rows a query, read more than once
    rows = R.with_text(R.within_delta(hits).join(t.queries, "query_id"), t.chunks)
    return R.drop_irrelevant(R.rerank(rows)).select("query_id", "chunk_id", "sentence_score", "rank")


@query("label_precision", D.with_("""sims AS (
  SELECT a.vec_id AS query_id, a.label AS query_label, v.label, v.vec_id::VARCHAR AS chunk_id,
         round(list_inner_product(a.embedding::DOUBLE[], v.embedding::DOUBLE[])
               / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
               / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS similarity
  FROM embeddings a, embeddings v)""") + """
SELECT query_label AS label, round(avg(CASE WHEN label = query_label THEN 1.0 ELSE 0.0 END), 6) AS precision_at_6
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims) x
WHERE rank <= 6 GROUP BY 1""")
def label_precision(t):
    """Share of a vector's six nearest vectors with its own label."""
    every = t.table("embeddings")
    asked = every.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = R.dense_leg(asked, t.vectors, 6)
    mine = every.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    theirs = t.vectors.select("chunk_id", "label")
    return (
        near.join(mine, "query_id").join(theirs, "chunk_id").groupBy(F.col("query_label").alias("label"))
        .agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("precision_at_6"))
    )


# --- bundles -----------------------------------------------------------------


def _seed_hits(t, counts=None):
    return R.retrieve(t.vector_queries, t.chunks, t.vectors, K_SEED, require_all=False, counts=counts)


def _hits_and_counts(t):
    counts = R.term_counts(t.chunks, R.query_terms(t.queries))
    return durable(_seed_hits(t, counts)), counts


def bundle_of(t, found=None) -> S.Bundle:
    hits, counts = _hits_and_counts(t) if found is None else found
    return S.evidence_bundle(t.queries, t.chunks, t.edges, hits, counts=counts)


@query("edge_expansion", D.with_(*BUNDLE) + "SELECT query_id, src, dst, edge_type FROM touching")
def edge_expansion(t):
    return bundle_of(t).edges


@query("neighbour_chunks", D.with_(*BUNDLE) + "SELECT query_id, chunk_id FROM members WHERE NOT is_seed")
def neighbour_chunks(t):
    bundle_seeds = durable(reranked_seeds(t))
    return S.neighbours(bundle_seeds, S.edges_touching(bundle_seeds, t.edges))


@query("bundle_pairs", D.with_(*BUNDLE) + "SELECT query_id, src, dst, edge_type FROM pairs")
def bundle_pairs(t):
    return bundle_of(t).pairs


@query("bundle_hits", D.with_(*BUNDLE) + "SELECT query_id, chunk_id, position, is_seed, dense_rank, sparse_rank, rrf_score FROM bundle")
def bundle_hits(t):
    return bundle_of(t).hits.select(
        "query_id", "chunk_id", "position", "is_seed", "dense_rank", "sparse_rank", "rrf_score"
    )


@query("bundle_mode", D.with_(*BUNDLE) + """
SELECT q.query_id, CASE WHEN p.query_id IS NOT NULL THEN 'divergent' ELSE 'convergent' END AS mode
FROM queryset q LEFT JOIN (SELECT DISTINCT query_id FROM pairs WHERE edge_type = 'contradicts') p ON p.query_id = q.query_id""")
def bundle_mode(t):
    return bundle_of(t).mode


@query("blunt_mode", D.with_(*BUNDLE) + """
SELECT s.query_id, CASE WHEN bool_or(e.query_id IS NOT NULL) OR
         (count(DISTINCT CASE WHEN s.top - s.rrf_score <= 0.15 THEN s.chunk_id END) >= 2
          AND (count(DISTINCT c.outlet) > 1 OR count(DISTINCT c.doc_id) > 1))
       THEN 'divergent' ELSE 'convergent' END AS mode
FROM (SELECT *, max(rrf_score) OVER (PARTITION BY query_id) AS top FROM seeds) s
JOIN chunks c ON c.chunk_id = s.chunk_id
LEFT JOIN (SELECT DISTINCT query_id FROM touching WHERE edge_type = 'contradicts') e ON e.query_id = s.query_id
GROUP BY 1""")
def blunt_mode(t):
    found = _hits_and_counts(t)
    bundle = bundle_of(t, found)
    seeds = bundle_seeds(t, found[0]).join(t.chunks.select("chunk_id", "doc_id", "outlet"), "chunk_id")
    return S.blunt_mode(seeds, bundle.edges)


def bundle_seeds(t, hits):
    return reranked_seeds(t, hits).join(hits.select("query_id", "chunk_id", "rrf_score"), ["query_id", "chunk_id"])
