"""Documents in: identity, deduplication, upserts, manifests, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from .retrieval import CONFIDENCE_FLOOR

# Fixed values.
DOCUMENT_FIELDS = ("doc_id", "global_id", "source", "url", "node")
METADATA_FIELDS = ("domain", "date", "type", "author", "category")
SNIPPET = 60


def filled(*candidates: Column) -> Column:
    """First candidate with anything but whitespace in it, else empty."""
    kept = [F.when(T.trimmed(c) != "", T.trimmed(c)) for c in candidates]
    return F.coalesce(*kept, F.lit(""))


def document_id(title: Column, authors: Column, source: Column, content_hash: Column) -> Column:
    """Hash of title, authors and source when any is known, else the content hash."""
    named = F.concat_ws("|", F.trim(title), F.array_join(F.transform(authors, F.trim), ","), F.trim(source))
    known = (F.trim(title) != "") | (F.size(authors) > 0) | (F.trim(source) != "")
    return F.when(known, H.content_hash(named)).otherwise(content_hash)


def document_uuid(doc_id: Column, prefix: str) -> Column:
    return H.name_uuid(F.concat(F.lit(prefix), doc_id))


def chunk_rows(documents: DataFrame) -> DataFrame:
    """documents(doc_id, chunks array) -> chunks with id ``doc:index`` and head sentence."""
    rows = documents.select("doc_id", F.posexplode("chunks").alias("chunk_index", "text"))
    return rows.select(
        F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text",
        T.head_sentence(F.col("text")).alias("head_sentence"), H.content_hash(F.col("text")).alias("content_hash"),
    )


def document_text(chunks: DataFrame) -> DataFrame:
    """A document's text is its chunks in order, joined by a blank line."""
    cells = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(cells, lambda c: c["text"]), "\n\n").alias("text"))


def new_blobs(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """One blob per content hash the store does not hold yet."""
    blobs = documents.groupBy(H.content_hash(F.col("text")).alias("content_hash")).agg(F.first("text").alias("content"))
    fresh = blobs.join(stored.select("content_hash"), "content_hash", "left_anti")
    return fresh.withColumn("prefix", F.substring("content_hash", 1, 2))


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Last writer wins per key; a combinable maximum, so hot keys fold early."""
    row = F.struct(*[F.col(c) for c in existing.columns])
    both = existing.unionByName(incoming.select(*existing.columns))
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, F.col(order)).alias("row")).select("row.*")


def upserted_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents keyed by content: the first id stays, later fields replace."""
    both = existing.unionByName(incoming.select(*existing.columns))
    rest = F.struct(*[F.col(c) for c in existing.columns if c not in ("doc_id", "content_hash")])
    return (
        both.groupBy("content_hash")
        .agg(F.min_by("doc_id", "seq").alias("doc_id"), F.max_by(rest, "seq").alias("last"))
        .select("doc_id", "content_hash", "last.*")
    )


def ingest_stats(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts for the run log."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("content_hash").alias("distinct_contents")
    ).select(
        "documents", "distinct_contents", (F.col("documents") - F.col("distinct_contents")).alias("deduped"),
        chunks.agg(F.count(F.lit(1))).scalar().alias("chunks"), edges.agg(F.count(F.lit(1))).scalar().alias("edges"),
    )


# --- manifests ---------------------------------------------------------------


def manifest_entries(documents: DataFrame, version: Column) -> DataFrame:
    return documents.select(
        "doc_id", version.alias("version"), H.blob_path(F.col("content_hash")).alias("storage_path"), "content_hash"
    )


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """Entries of the highest version number."""
    return manifests.where(F.col("version") == manifests.agg(F.max("version")).scalar())


def texts_of_manifest(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    return manifest.join(blobs.select("content_hash", "content"), "content_hash").select(
        "doc_id", "version", F.col("content").alias("text")
    )


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def retrieval_manifests(queries: DataFrame, bundle, chunks: DataFrame) -> DataFrame:
    """Content address of each query's retrieval: hash of its canonical JSON
    (sorted keys, no blanks, ASCII).  A bundle holds a few hits per query."""
    labels = chunks.select("chunk_id", "outlet", "title")
    q = H.json_text
    entry = F.concat(
        F.lit('{"chunk_id":'), q(F.col("chunk_id")), F.lit(',"dense_rank":'), _number(F.col("dense_rank")),
        F.lit(',"outlet":'), q(F.col("outlet")), F.lit(',"rrf_score":'), F.col("rrf_score").cast("string"),
        F.lit(',"sparse_rank":'), _number(F.col("sparse_rank")), F.lit(',"title":'), q(F.col("title")), F.lit("}"),
    )
    entries = (
        bundle.hits.join(labels, "chunk_id").withColumn("entry", entry).groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "entry"))).alias("cells"), F.max("rrf_score").alias("top"))
        .select("query_id", F.array_join(F.transform("cells", lambda c: c["entry"]), ",").alias("entries"),
                F.size("cells").alias("n_entries"), "top")
    )
    types = bundle.edges.groupBy("query_id").agg(F.array_sort(F.collect_set("edge_type")).alias("types"))
    rows = queries.select("query_id", "query").join(bundle.mode, "query_id").join(entries, "query_id", "left").join(types, "query_id", "left")
    query_hash = H.content_hash(F.col("query"))
    shown_types = F.coalesce(F.array_join(F.transform("types", q), ","), F.lit(""))
    body = F.concat(
        F.lit('{"edge_types":['), shown_types, F.lit('],"entries":['), F.coalesce("entries", F.lit("")),
        F.lit('],"query":'), q(F.col("query")), F.lit(',"query_hash":"'), query_hash,
        F.lit('","synthesis_mode":'), q(F.col("mode")), F.lit("}"),
    )
    return rows.select(
        "query_id", query_hash.alias("query_hash"), "mode", F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.array_join(F.coalesce("types", F.array().cast("array<string>")), ",").alias("edge_types"),
        F.coalesce(F.col("top") >= CONFIDENCE_FLOOR, F.lit(False)).alias("confident"),
        H.content_hash(body).alias("manifest_hash"),
    )


def source_lists(bundle, chunks: DataFrame) -> DataFrame:
    """Per query: numbered source lines, then how the sources relate."""
    flat = F.replace(T.trimmed(F.col("head")), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(flat) <= SNIPPET, flat).otherwise(F.concat(F.substring(flat, 1, SNIPPET - 3), F.lit("...")))
    labels = chunks.select("chunk_id", "outlet", T.head_sentence(F.col("text")).alias("head"))
    line = F.concat(
        F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("outlet"), F.lit(' — "'), short,
        F.lit('" (chunk '), F.col("chunk_id"), F.lit(")"),
    )
    gather = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["line"]), "\n")
    sources = bundle.hits.join(labels, "chunk_id").withColumn("line", line).groupBy("query_id").agg(
        gather(F.struct("position", "line")).alias("sources")
    )
    place = lambda key, name: bundle.hits.select("query_id", F.col("chunk_id").alias(key), F.col("position").alias(name))
    relation = F.format_string("Relationship: [%d] %s [%d].", F.col("p"), F.col("edge_type"), F.col("q"))
    related = (
        bundle.pairs.join(place("src", "p"), ["query_id", "src"]).join(place("dst", "q"), ["query_id", "dst"])
        .withColumn("line", relation).groupBy("query_id").agg(gather(F.struct("src", "dst", "line")).alias("relations"))
    )
    return sources.join(related, "query_id", "left").select(
        "query_id", F.concat_ws("\n", F.lit("Sources:"), "sources", "relations").alias("source_list")
    )


# --- validation --------------------------------------------------------------


def corpus_faults(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, fault) for every rule a node corpus breaks.

    documents: doc_id, global_id, source, url, node, metadata (map), node_id.
    chunks: doc_id, chunk_id, position, text.
    """
    missing = [F.when(F.col(f).isNull(), F.lit(f"missing field {f}")) for f in DOCUMENT_FIELDS]
    missing += [
        F.when(~F.coalesce(F.map_contains_key("metadata", f), F.lit(False)), F.lit(f"metadata missing {f}")) for f in METADATA_FIELDS
    ]
    form = F.when(~F.coalesce(F.col("global_id").rlike("^gid_[0-9a-f]{16}$"), F.lit(False)), F.lit("bad global_id"))
    home = F.when(F.col("node") != F.col("node_id"), F.lit("node differs from node_id"))
    found = F.array_compact(F.array(*missing, form, home))
    own = documents.select("doc_id", F.explode(found).alias("fault"))
    repeated = lambda key: documents.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where(
        (F.col("n") > 1) & F.col(key).isNotNull()
    ).select(F.col("first").alias("doc_id"), F.lit(f"duplicate {key}").alias("fault"))
    expected = F.concat(F.col("doc_id"), F.lit("_c"), F.lpad(F.col("position").cast("string"), 3, "0"))
    cell_faults = F.array_compact(F.array(
        F.when(F.col("chunk_id") != expected, F.lit("bad chunk_id")),
        F.when(T.trimmed(F.coalesce("text", F.lit(""))) == "", F.lit("empty text")),
    ))
    cells = chunks.select("doc_id", F.explode(cell_faults).alias("fault"))
    counts = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi")
    )
    gaps = documents.select("doc_id").distinct().join(counts, "doc_id", "left").where(
        F.col("n").isNull() | (F.col("d") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)
    ).select("doc_id", F.when(F.col("n").isNull(), "no chunks").otherwise("bad positions").alias("fault"))
    return own.unionByName(repeated("doc_id")).unionByName(repeated("global_id")).unionByName(cells).unionByName(gaps)
