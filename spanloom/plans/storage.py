"""Registered queries: ingest, upserts, manifests, prompts, validation, traces, pair heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import vectors as V
from ..operators import frames as M
from ..operators import ingest as G
from ..operators import relations as X
from ..sources import readers as S
from ..streaming import traces as Z
from . import dialect as D
from . import search
from .registry import query


# --- identity and deduplication ------------------------------------------------


@query("document_ids", """
SELECT doc_id, sha256(text) AS content_hash,
       CASE WHEN lang <> 'en' OR source = 'src1' THEN sha256(CASE WHEN lang = 'en' THEN '' ELSE lang END || '||' || CASE WHEN source = 'src1' THEN source ELSE '' END)
            ELSE sha256(text) END AS identity
FROM documents""")
def document_ids(t):
    """The language stands in for a title (English: none), one source is named."""
    digest = H.content_hash(F.col("text"))
    title = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    source = F.when(F.col("source") == "src1", F.col("source")).otherwise("")
    none = F.array().cast("array<string>")
    return t.table("documents").select(
        "doc_id", digest.alias("content_hash"), G.document_id(title, none, source, digest).alias("identity")
    )


@query("document_uuids", """
WITH digests AS (
  SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('spanloom:doc:' || doc_id)::BLOB) AS h FROM documents)
SELECT doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
       || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM digests""")
def document_uuids(t):
    return t.table("documents").select("doc_id", G.document_uuid(F.col("doc_id").cast("string"), "spanloom:doc:").alias("uuid"))


@query("new_blobs", """
SELECT DISTINCT sha256(text) AS content_hash, left(sha256(text), 2) AS prefix FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""")
def new_blobs(t):
    """Blobs to store when those of labelled documents are stored already."""
    labelled = t.table("documents").join(t.table("labels").select("doc_id"), "doc_id", "left_semi")
    stored = labelled.select(H.content_hash(F.col("text")).alias("content_hash")).distinct()
    return G.new_blobs(t.table("documents"), stored).select("content_hash", "prefix")


@query("document_upsert", """
SELECT sha256(text) AS content_hash, min_by(doc_id, doc_id)::VARCHAR AS doc_id, max_by(source, doc_id) AS outlet, max_by(lang, doc_id) AS domain
FROM documents GROUP BY 1""")
def document_upsert(t):
    """Even and odd arrivals collapse on content: first id, last labels."""
    rows = t.table("documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), H.content_hash(F.col("text")).alias("content_hash"),
        F.col("source").alias("outlet"), F.col("lang").alias("domain"), F.col("doc_id").alias("seq"),
    )
    even = F.col("seq") % 2 == 0
    return G.upserted_documents(rows.where(even), rows.where(~even)).select("content_hash", "doc_id", "outlet", "domain")


@query("edge_upsert", """
SELECT user_id::VARCHAR AS src, event_type AS dst, max_by(value, event_id) AS confidence, max(event_id) AS seq FROM events GROUP BY 1, 2""")
def edge_upsert(t):
    """Last write per (user, event type) over the event log."""
    rows = t.table("events").select(
        F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"),
        F.col("value").alias("confidence"), F.col("event_id").alias("seq"),
    )
    return G.upserted(rows.where(F.col("confidence") < 20), rows.where(F.col("confidence") >= 20), ["src", "dst"])


@query("line_chunks", D.with_(D.LINES) + rf"""
SELECT doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1) AS chunk_id, sha256(text) AS content_hash,
       {D.trimmed("CASE WHEN head <> '' THEN head ELSE string_split(body, chr(10))[1] END")} AS head_sentence
FROM (SELECT *, {D.trimmed('text')} AS body, regexp_extract({D.trimmed('text')}, '[^.!?]+[.!?]') AS head FROM lines) l""")
def line_chunks(t):
    docs = t.documents.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "").alias("chunks"),
    )
    return G.chunk_rows(docs).select("chunk_id", "content_hash", "head_sentence")


@query("document_texts", D.with_(D.LINES) + """
SELECT doc_id::VARCHAR AS doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY position)) AS content_hash FROM lines GROUP BY 1""")
def document_texts(t):
    rows = t.lines.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("position").alias("chunk_index"), "text")
    return G.document_text(rows).select("doc_id", H.content_hash(F.col("text")).alias("content_hash"))


@query("ingest_stats", D.with_(D.LINES, D.EDGES) + """
SELECT count(*) AS documents, count(DISTINCT sha256(text)) AS distinct_contents, count(*) - count(DISTINCT sha256(text)) AS deduped,
       (SELECT count(*) FROM lines) AS chunks, (SELECT count(*) FROM edges) AS edges FROM documents""")
def ingest_stats(t):
    return G.ingest_stats(t.anchors, t.lines, t.edges)


@query("listed_chunks", """
SELECT doc_id::VARCHAR AS chunk_id, source AS outlet FROM documents WHERE lang = 'de' AND source NOT IN ('src0')""")
def listed_chunks(t):
    """Chunks of one layer joined to their documents, one source left out."""
    from ..operators.retrieval import chunk_filter

    chunks = chunk_filter(t.chunks, eval_layer="de").select(
        F.concat_ws(":", "outlet", "chunk_id").alias("chunk_id"), "doc_id"
    )
    docs = t.chunks.select("doc_id", "outlet", F.col("eval_layer").alias("title"))
    rows = S.chunks_with_outlets(chunks, docs, exclude=("src0",))
    return rows.select(F.substring_index("chunk_id", ":", -1).alias("chunk_id"), "outlet")


# --- manifests -----------------------------------------------------------------


def manifests(t):
    """Version 1 holds the labelled documents, version 2 all of them."""
    docs = t.anchors.select(F.col("chunk_id").alias("doc_id"), "content_hash")
    labelled = docs.join(t.table("labels").select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
    return G.manifest_entries(labelled, F.lit(1)).unionByName(G.manifest_entries(docs, F.lit(2)))


@query("latest_manifest", """
SELECT doc_id::VARCHAR AS doc_id, 2 AS version, left(sha256(text), 2) || '/' || sha256(text) AS storage_path, sha256(text) AS content_hash FROM documents""")
def latest_manifest(t):
    return G.latest_manifest(manifests(t))


@query("manifest_texts", """
SELECT d.doc_id::VARCHAR AS doc_id, 1 AS version, length(text) AS n_chars FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)""")
def manifest_texts(t):
    """A past version read back from the blob store."""
    blobs = t.documents.groupBy(H.content_hash(F.col("text")).alias("content_hash")).agg(F.first("text").alias("content"))
    old = manifests(t).where(F.col("version") == 1)
    return G.texts_of_manifest(old, blobs).select("doc_id", "version", F.length("text").alias("n_chars"))


def titled(t):
    return t.chunks.withColumn("title", F.col("eval_layer"))


@query("retrieval_manifests")
def retrieval_manifests(t):
    return G.retrieval_manifests(t.queries, search.bundle_of(t), titled(t))


SOURCE_LISTS = rf"""
SELECT b.query_id, 'Sources:' || chr(10) || string_agg('[' || b.position || '] ' || c.outlet || ' — "' ||
         CASE WHEN length(c.head) <= 60 THEN c.head ELSE left(c.head, 57) || '...' END || '" (chunk ' || b.chunk_id || ')', chr(10) ORDER BY b.position)
       || coalesce(max(r.relations), '') AS source_list
FROM bundle b JOIN (
  SELECT chunk_id, outlet, replace({D.trimmed(D.trimmed("CASE WHEN h <> '' THEN h ELSE string_split(body, chr(10))[1] END"))}, chr(10), ' ') AS head
  FROM (SELECT *, {D.trimmed('text')} AS body, regexp_extract({D.trimmed('text')}, '[^.!?]+[.!?]') AS h FROM chunks) x) c ON c.chunk_id = b.chunk_id
LEFT JOIN (SELECT p.query_id, chr(10) || string_agg('Relationship: [' || x.position || '] ' || p.edge_type || ' [' || y.position || '].', chr(10) ORDER BY p.src, p.dst) AS relations
           FROM pairs p JOIN bundle x ON x.query_id = p.query_id AND x.chunk_id = p.src JOIN bundle y ON y.query_id = p.query_id AND y.chunk_id = p.dst
           GROUP BY 1) r ON r.query_id = b.query_id
GROUP BY 1"""


@query("source_lists", D.with_(*search.BUNDLE) + SOURCE_LISTS)
def source_lists(t):
    return G.source_lists(search.bundle_of(t), t.chunks)


# --- validation ------------------------------------------------------------------


@query("corpus_faults", """
WITH docs AS (
  SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN 'gid_' || left(sha256(url), 16) ELSE 'gid_' || left(sha256(url), 9) END AS gid,
         CASE WHEN length(url) % 2 = 0 THEN 'web' ELSE 'other' END AS node FROM pages)
SELECT page_id::VARCHAR AS doc_id, 'bad global_id' AS fault FROM docs WHERE NOT regexp_full_match(gid, 'gid_[0-9a-f]{16}')
UNION ALL SELECT page_id::VARCHAR, 'node differs from node_id' FROM docs WHERE node <> 'web'
UNION ALL SELECT page_id::VARCHAR, 'metadata missing author' FROM docs
UNION ALL SELECT min(page_id::VARCHAR), 'duplicate global_id' FROM docs GROUP BY gid HAVING count(*) > 1
UNION ALL SELECT page_id::VARCHAR, 'bad chunk_id' FROM pages WHERE page_id % 2 = 1""")
def corpus_faults(t):
    """Pages as node documents, with faults that follow from their own fields."""
    gid = F.concat(F.lit("gid_"), F.substring(H.content_hash(F.col("url")), 1, F.when(F.length("html") % 3 == 0, 16).otherwise(9)))
    pages = t.table("pages")
    known = F.create_map(*[F.lit(x) for f in G.METADATA_FIELDS if f != "author" for x in (f, "x")])
    docs = pages.select(
        F.col("page_id").cast("string").alias("doc_id"), gid.alias("global_id"), F.lit("page").alias("source"), "url",
        F.when(F.length("url") % 2 == 0, "web").otherwise("other").alias("node"), known.alias("metadata"), F.lit("web").alias("node_id"),
    )
    cells = pages.select(
        F.col("page_id").cast("string").alias("doc_id"), F.lit(0).alias("position"), F.col("html").alias("text"),
        F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 1, "_x000").otherwise("_c000")).alias("chunk_id"),
    )
    return G.corpus_faults(docs, cells)


# --- traces ----------------------------------------------------------------------


@query("trace_requests", """
WITH tr AS (SELECT user_id::VARCHAR AS request_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'final' ELSE 'claim_closed' END AS event FROM events)
SELECT request_id, count(*) AS n_events, count(*) FILTER (event = 'claim_closed') AS n_claims, bool_or(event IN ('final', 'error')) AS closed,
       max(seq) = max(CASE WHEN event IN ('final', 'error') THEN seq END) AS closed_last, max_by(event, seq) AS last_event
FROM tr GROUP BY 1""")
def trace_requests(t):
    kind = F.col("event_type")
    rows = t.table("events").select(
        F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "error").when(kind == "purchase", "final").otherwise("claim_closed").alias("event"),
    )
    return Z.request_summaries(rows)


# --- pair heads ------------------------------------------------------------------


def head_pairs(t):
    """Successive vectors as labelled pairs: equal labels agree, neighbours in
    label number are related, an even sum diverges, the rest are unrelated."""
    here = t.table("embeddings").select("vec_id", "label")
    ahead = here.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("next_label"))
    gap = F.abs(F.col("label") - F.col("next_label"))
    return here.join(ahead, "vec_id").select(
        F.col("vec_id").cast("string").alias("src"), (F.col("vec_id") + 1).cast("string").alias("dst"),
        F.when(gap == 0, "AGREE").when(gap == 1, "RELATED_UNTYPED").when(gap % 2 == 0, "DIVERGENT").otherwise("UNRELATED").alias("label"),
    )


@query("pair_cosines", """
SELECT a.vec_id::VARCHAR AS src, b.vec_id::VARCHAR AS dst,
       round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
             / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) + 0.0 AS cos
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_cosines(t):
    side = lambda key: t.vectors.select(F.col("chunk_id").alias(key), F.col("vector").alias(f"{key}_vector"))
    return head_pairs(t).join(side("src"), "src").join(side("dst"), "dst").select(
        "src", "dst", (F.round(V.cosine(F.col("src_vector"), F.col("dst_vector")), 6) + 0.0).alias("cos")
    )


@query("head_recalls")
def head_recalls(t):
    return M.class_recalls(M.held_out_predictions(M.pair_examples(head_pairs(t), t.vectors), folds=4))


@query("head_baseline")
def head_baseline(t):
    return M.permutation_baseline(M.held_out_predictions(M.pair_examples(head_pairs(t), t.vectors), folds=4))


@query("curated_proposals", """
SELECT user_id::VARCHAR AS src, event_id::VARCHAR AS dst, 'contradicts' AS relation, 'curated:issue_frame' AS method, 0.95::DOUBLE AS confidence
FROM events WHERE event_type = 'error'""")
def curated_proposals(t):
    gold = t.table("events").select(
        F.col("user_id").cast("string").alias("src"), F.col("event_id").cast("string").alias("dst"),
        F.when(F.col("event_type") == "error", "issue_frame").otherwise("story").alias("relation_class"),
    )
    return X.curated_proposals(gold)


@query("gold_edges", """
SELECT least(src, dst) || '|' || greatest(src, dst) AS pair, any_value('story') AS relation_class, count(DISTINCT 1) AS n
FROM (SELECT user_id::VARCHAR AS src, 'u' || json_extract_string(props, '$.k') AS dst FROM events WHERE event_type = 'error') x GROUP BY 1""")
def gold_edges(t):
    edges = t.table("events").select(
        F.col("user_id").cast("string").alias("src"), F.concat(F.lit("u"), F.get_json_object("props", "$.k")).alias("dst"),
        F.when(F.col("event_type") == "error", "contradicts").otherwise("cites").alias("edge_type"),
        F.lit(None).cast("string").alias("relation_class"),
    )
    rows = S.gold_edges(edges, F.lit("cross"))
    return rows.select(
        F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst")).alias("pair"), "relation_class"
    ).groupBy("pair", "relation_class").agg(F.count(F.lit(1)).alias("n"))
