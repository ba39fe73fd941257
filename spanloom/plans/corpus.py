"""Registered queries: text expressions, corpus statistics, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import digests, stats
from . import dialect as D
from .registry import query


@query("token_stats", D.with_(D.CHUNKS) + f"""
SELECT chunk_id, len({D.words('text')}) AS n_words, len({D.terms('text')}) AS n_terms,
       len({D.keywords('text')}) AS n_keywords,
       len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_whitespace
FROM chunks""")
def token_stats(t):
    text = F.col("text")
    return t.chunks.select(
        "chunk_id",
        F.size(T.words(text)).alias("n_words"),
        F.size(T.terms(text)).alias("n_terms"),
        F.size(T.keywords(text)).alias("n_keywords"),
        F.size(T.whitespace_words(text)).alias("n_whitespace"),
    )


@query("sentence_split", D.with_(D.CHUNKS) + f"""
SELECT chunk_id, i - 1 AS position, parts[i] AS sentence
FROM (SELECT chunk_id, {D.sentences('text')} AS parts FROM chunks) c, generate_series(1, len(parts)) g(i)""")
def sentence_split(t):
    return t.chunks.select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query("head_sentences", D.with_(D.CHUNKS) + rf"""
SELECT chunk_id, {D.trimmed("CASE WHEN head <> '' THEN head ELSE string_split(body, chr(10))[1] END")} AS head_sentence
FROM (SELECT chunk_id, {D.trimmed('text')} AS body, regexp_extract({D.trimmed('text')}, '[^.!?]+[.!?]') AS head FROM chunks) c""")
def head_sentences(t):
    return t.chunks.select("chunk_id", T.head_sentence(F.col("text")).alias("head_sentence"))


@query("query_keywords", D.with_(D.QUERYSET) + f"""
SELECT query_id, list_aggregate(list_sort({D.keywords('query')}), 'string_agg', ' ') AS keywords,
       list_aggregate(list_sort({D.folded_keywords('query')}), 'string_agg', ' ') AS folded
FROM queryset""")
def query_keywords(t):
    shown = lambda c: F.array_join(F.array_sort(c), " ")
    return t.queries.select(
        "query_id",
        shown(T.keywords(F.col("query"))).alias("keywords"),
        shown(T.folded_keywords(F.col("query"))).alias("folded"),
    )


@query("lead_anchors", D.with_(D.CHUNKS) + r"""
SELECT chunk_id, 0 AS anchor_start,
       CASE WHEN len(closing) > 0 THEN list_min(closing) ELSE len(parts) END AS anchor_end
FROM (SELECT chunk_id, parts, list_filter(list_transform(parts, lambda w, i:
             CASE WHEN regexp_matches(w, '[.!?]$') THEN i END), lambda i: i IS NOT NULL) AS closing
      FROM (SELECT chunk_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS parts FROM chunks) a) b""")
def lead_anchors(t):
    anchor = T.lead_anchor(F.col("text"))
    return t.chunks.select("chunk_id", anchor["start"].alias("anchor_start"), anchor["end"].alias("anchor_end"))


@query("entity_terms", D.with_(D.CHUNKS) + f"""
SELECT chunk_id, len({D.anchor_terms('text')}) AS n_anchor, len({D.capital_terms('text')}) AS n_capital,
       md5(coalesce(list_aggregate(list_sort({D.anchor_terms('text')}), 'string_agg', ' '), '')) AS anchor_digest
FROM chunks""")
def entity_terms(t):
    anchors = T.anchor_terms(F.col("text"))
    return t.chunks.select(
        "chunk_id",
        F.size(anchors).alias("n_anchor"),
        F.size(T.capital_terms(F.col("text"))).alias("n_capital"),
        F.md5(F.array_join(F.array_sort(anchors), " ").cast("binary")).alias("anchor_digest"),
    )


@query("stable_ids", """
SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 2) || '/' || sha256(text) AS blob_path,
       'gid_' || left(sha256(source || '|' || doc_id), 16) AS global_id
FROM documents""")
def stable_ids(t):
    digest = H.content_hash(F.col("text"))
    return t.table("documents").select(
        "doc_id",
        digest.alias("content_hash"),
        H.blob_path(digest).alias("blob_path"),
        H.prefixed_id(F.concat_ws("|", "source", "doc_id")).alias("global_id"),
    )


@query("corpus_idf", D.with_(D.CHUNKS, D.POSTINGS, D.IDF) + "SELECT term, df, round(idf, 9) AS idf FROM idf")
def corpus_idf(t):
    return stats.idf(t.chunks).select("term", "df", F.round("idf", 9).alias("idf"))


@query("rare_terms", D.with_(D.CHUNKS, D.POSTINGS, D.IDF) + """
SELECT term, df FROM idf WHERE df <= greatest(2, (SELECT count(*) FROM chunks) // 30)""")
def rare_terms(t):
    return stats.rare_terms(t.chunks).select("term", "df")


@query("content_groups", """
SELECT sha256(text) AS content_hash, min(doc_id::VARCHAR) AS chunk_id, count(*) AS copies
FROM documents GROUP BY 1""")
def content_groups(t):
    return stats.distinct_contents(t.chunks).select("content_hash", "chunk_id", "copies")


@query("corpus_fingerprint", D.with_(D.ANCHORS) + f"""
SELECT n AS chunk_count, left(digest, 16) AS content_hash
FROM ({D.digest_tree("anchors", "chunk_id || ':' || content_hash", 0)}) t""")
def corpus_fingerprint(t):
    return digests.corpus_fingerprint(t.anchors)


@query("merkle_buckets", D.with_(D.ANCHORS, D.buckets("anchors", "b")) + "SELECT bucket, bucket_hash, n FROM b")
def merkle_buckets(t):
    return digests.bucket_digests(t.anchors)


@query("merkle_root", D.with_(D.ANCHORS, D.buckets("anchors", "b")) + """
SELECT sha256(string_agg(bucket_hash, '|' ORDER BY bucket)) AS root_hash FROM b""")
def merkle_root(t):
    return digests.root_digest(digests.bucket_digests(t.anchors))


@query("anchor_diff", D.with_(D.ANCHORS, D.REMOTE) + """
SELECT coalesce(a.chunk_id, r.chunk_id) AS chunk_id,
       CASE WHEN a.chunk_id IS NULL THEN 'added' WHEN r.chunk_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
       r.content_hash, r.outlet, r.title
FROM anchors a FULL JOIN remote r ON a.chunk_id = r.chunk_id
WHERE a.chunk_id IS NULL OR r.chunk_id IS NULL
   OR (a.content_hash, a.outlet, a.title) IS DISTINCT FROM (r.content_hash, r.outlet, r.title)""")
def anchor_diff(t):
    return digests.anchor_diff(t.anchors, t.remote_anchors)


@query("anchor_sync_plan", D.with_(D.ANCHORS, D.REMOTE, D.buckets("anchors", "a"), D.buckets("remote", "r")) + """
SELECT a.bucket, a.bucket_hash AS local_hash, r.bucket_hash AS remote_hash
FROM a JOIN r ON a.bucket = r.bucket WHERE a.bucket_hash <> r.bucket_hash""")
def anchor_sync_plan(t):
    return digests.mismatched_buckets(
        digests.bucket_digests(t.anchors), digests.bucket_digests(t.remote_anchors)
    )


@query("anchor_sync_result", D.with_(D.ANCHORS, D.REMOTE) + "SELECT chunk_id, content_hash, outlet, title FROM remote")
def anchor_sync_result(t):
    stale = anchor_sync_plan(t)
    return digests.synced_anchors(t.anchors, t.remote_anchors, stale)


@query("anchor_sync_cost", D.with_(D.ANCHORS, D.REMOTE, D.buckets("anchors", "a"), D.buckets("remote", "r")) + """
SELECT count(DISTINCT CASE WHEN moved THEN bucket END) AS buckets_synced,
       coalesce(sum(CASE WHEN moved THEN size END), 0)::BIGINT AS leaf_bytes_moved, sum(size)::BIGINT AS leaf_bytes_all
FROM (SELECT x.bucket, x.size, m.bucket IS NOT NULL AS moved
      FROM (SELECT strpos('0123456789abcdef', left(sha256(chunk_id), 1)) - 1 AS bucket,
                   length(chunk_id) + length(content_hash) + length(outlet) + length(title) + 16 AS size FROM remote) x
      LEFT JOIN (SELECT a.bucket FROM a JOIN r ON a.bucket = r.bucket WHERE a.bucket_hash <> r.bucket_hash) m
        ON m.bucket = x.bucket) z""")
def anchor_sync_cost(t):
    return digests.sync_cost(
        digests.bucket_digests(t.anchors), digests.bucket_digests(t.remote_anchors), t.remote_anchors
    )


@query("peer_terms", D.with_(D.CHUNKS) + f"""
SELECT outlet, term, df, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf, rank FROM (
  SELECT p.outlet, p.term, p.df, s.n, row_number() OVER (PARTITION BY p.outlet ORDER BY p.df, p.term) AS rank
  FROM (SELECT outlet, term, count(*) AS df FROM (SELECT outlet, unnest({D.terms('text')}) AS term FROM chunks) u
        GROUP BY 1, 2) p
  JOIN (SELECT outlet, count(*) AS n FROM chunks GROUP BY 1) s ON s.outlet = p.outlet) x WHERE rank <= 40""")
def peer_terms(t):
    return stats.top_terms(t.chunks, "outlet").select(
        "outlet", "term", "df", F.round("idf", 9).alias("idf"), "rank"
    )


CENTROIDS = """means AS (
  SELECT label, i AS pos, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1, 2),
centroids AS (
  SELECT m.label, m.pos, CASE WHEN s.len = 0 THEN m.mean ELSE m.mean / s.len END AS value
  FROM means m JOIN (SELECT label, sqrt(sum(mean * mean)) AS len FROM means GROUP BY 1) s ON s.label = m.label)"""


@query("peer_centroid", D.with_(CENTROIDS) + "SELECT label, pos - 1 AS pos, round(value, 6) + 0.0 AS value FROM centroids")
def peer_centroid(t):
    return stats.unit_mean(t.vectors, "label", "vector").select(
        "label", F.posexplode("centroid").alias("pos", "value")
    ).withColumn("value", F.round("value", 6) + 0.0)
