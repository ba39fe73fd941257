"""Reading outside files into typed DataFrames; every schema is declared."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..operators.ingest import filled

# Closed domains.
EVAL_LAYERS = ("realism", "counterfactual", "out_of_scope", "convergent")
EDGE_TYPES = ("cites", "contradicts", "supersedes", "translated_from")
RELATIONS = ("contradicts", "corroborates", "supersedes", "related_untyped", "unrelated")
EXPECTATIONS = ("answerable", "counterfactual", "out_of_scope")

NODE_SCHEMA = """node_id string, documents array<struct<doc_id: string, global_id: string, source: string, url: string, node: string,
  metadata: map<string,string>, chunks: array<struct<chunk_id: string, position: string, text: string>>>>"""
LOCAL_SCHEMA = "body string, text string, content string, title string, authors string, source string, source_uri string, published_at string"
LABEL_SCHEMA = """seq bigint, id string, src_chunk_id string, dst_chunk_id string, relation string, relation_class string, rationale string,
  curator string, ts string, supersedes string, src_anchor array<int>, dst_anchor array<int>"""
SAMPLE_SCHEMA = "src string, dst string, cos double, p_contra double, relation string, same_story boolean, stance string"
QUERY_SCHEMA = Ty.StructType([
    Ty.StructField("id", Ty.StringType()), Ty.StructField("query", Ty.StringType()), Ty.StructField("eval_layer", Ty.StringType()),
    Ty.StructField("eval_tag", Ty.StringType()), Ty.StructField("expectation", Ty.StringType()),
    Ty.StructField("gold_chunk_ids", Ty.ArrayType(Ty.StringType())), Ty.StructField("counterfactual_answer", Ty.StringType()),
    Ty.StructField("contradicts_pairs", Ty.ArrayType(Ty.ArrayType(Ty.StringType()))), Ty.StructField("regression", Ty.BooleanType()),
])
DOC_SCHEMA = "doc_id string, outlet string, title string, eval_layer string, eval_tag string, source_uri string, source_type string, chunks array<string>"
EDGE_SCHEMA = "src string, dst string, edge_type string, note string, relation_class string"


class SourceError(ValueError):
    """A file that breaks its declared form."""


def _yaml(path: str | Path):
    try:
        import yaml
    except ImportError as exc:  # optional dependency
        raise SourceError("reading YAML needs PyYAML") from exc
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def checked(df: DataFrame, column: str, allowed) -> DataFrame:
    """Fail the job on a value outside a closed domain."""
    ok = F.col(column).isNull() | F.col(column).isin(*allowed)
    fault = F.raise_error(F.concat(F.lit(f"bad {column}: "), F.col(column)))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(fault.cast("string")))


def yaml_corpus(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """A hand-written corpus file: (documents with chunks, edges)."""
    raw = _yaml(path)
    docs = []
    for d in raw.get("documents") or []:
        chunks = d.get("chunks") or ([d["body"]] if d.get("body") else [])
        if not chunks:
            raise SourceError(f"document {d.get('id')!r} has no chunks")
        docs.append((d["id"], d.get("outlet", ""), d.get("title", ""), d.get("eval_layer", "realism"), d.get("eval_tag"),
                     d.get("source_uri", ""), d.get("source_type", ""), [c.strip() for c in chunks]))
    edges = [(e["src"], e["dst"], e["type"], e.get("note", ""), e.get("relation_class")) for e in raw.get("edges") or []]
    return (
        checked(spark.createDataFrame(docs, DOC_SCHEMA), "eval_layer", EVAL_LAYERS),
        checked(spark.createDataFrame(edges, EDGE_SCHEMA), "edge_type", EDGE_TYPES),
    )


def node_corpus(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Node JSON files: (documents, chunks sorted by position).

    Positions are integers in some files and text in others; they order as text
    there and as numbers here only when every one of a document's is a number.
    """
    raw = spark.read.schema(NODE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    docs = raw.select("node_id", F.explode("documents").alias("d")).select("node_id", "d.*")
    ordered = F.array_sort(
        F.transform("chunks", lambda c: F.struct(
            F.coalesce(c["position"].try_cast("int"), F.lit(2**31 - 1)).alias("n"), c["position"].alias("position"), c["text"].alias("text")
        ))
    )
    chunks = docs.select("doc_id", F.posexplode(ordered).alias("chunk_index", "c")).select(
        F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", F.col("c.text").alias("text")
    )
    documents = docs.select(
        "doc_id", F.col("node").alias("outlet"), F.col("source").alias("title"), F.col("metadata")["category"].alias("eval_tag"),
        F.coalesce(F.col("metadata")["domain"], F.lit("")).alias("domain"), "global_id", "url", "node", "node_id", "source", "metadata",
    )
    return documents, chunks


def first_by_id(chunks: DataFrame, order: str) -> DataFrame:
    """First chunk of every id in reading order."""
    return chunks.groupBy("chunk_id").agg(F.min_by("text", order).alias("text"))


def latest_text(*sources: DataFrame) -> DataFrame:
    """Text per chunk id over several sources; a later source replaces an earlier."""
    both = None
    for i, rows in enumerate(sources):
        part = rows.select("chunk_id", "text", F.lit(i).alias("priority"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("chunk_id").agg(F.max_by("text", "priority").alias("text"))


def local_documents(spark: SparkSession, folder: str | Path) -> DataFrame:
    """A folder of .jsonl, .txt and .md files as (text, title, authors, source, input_path)."""
    folder, frames = Path(folder), []
    if not folder.exists():
        raise FileNotFoundError(str(folder))
    names = [p.suffix.lower() for p in folder.iterdir() if p.is_file()]
    if ".jsonl" in names:
        rows = spark.read.schema(LOCAL_SCHEMA).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(str(folder))
        people = F.coalesce(F.from_json("authors", "array<string>"), F.when(F.trim("authors") != "", F.array("authors")), F.array().cast("array<string>"))
        frames.append(rows.select(
            filled(F.col("body"), F.col("text"), F.col("content")).alias("text"), F.coalesce("title", F.lit("")).alias("title"),
            people.alias("authors"), filled(F.col("source"), F.col("source_uri")).alias("source"), F.input_file_name().alias("input_path"),
        ))
    if {".txt", ".md"} & set(names):
        rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").text(str(folder))
        name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]+$", 1)
        frames.append(rows.select(
            T.trimmed(F.col("value")).alias("text"), name.alias("title"), F.array().cast("array<string>").alias("authors"),
            F.lit("").alias("source"), F.input_file_name().alias("input_path"),
        ))
    if not frames:
        raise SourceError(f"nothing to read in {folder}")
    out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return out.where(F.col("text") != "")


def label_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only label log; a malformed line fails the read."""
    rows = spark.read.schema(LABEL_SCHEMA).option("mode", "FAILFAST").json(path)
    return as_labels(rows)


def as_labels(rows: DataFrame) -> DataFrame:
    return checked(rows.withColumnsRenamed({"src_chunk_id": "src", "dst_chunk_id": "dst"}), "relation", RELATIONS)


def query_set(spark: SparkSession, path: str | Path) -> DataFrame:
    """A validated query set; ids must be unique and expectations known."""
    raw = _yaml(path).get("queries") or []
    ids = [str(q["id"]) for q in raw]
    twice = {i for i in ids if ids.count(i) > 1}
    if twice:
        raise SourceError(f"duplicate query ids: {sorted(twice)}")
    rows = [
        (str(q["id"]), q["query"], q["eval_layer"], q.get("eval_tag"), q.get("expectation", "answerable"),
         list(q.get("gold_chunk_ids") or []), q.get("counterfactual_answer"), [list(p) for p in q.get("contradicts_pairs") or []],
         bool(q.get("regression", True)))
        for q in raw
    ]
    df = spark.createDataFrame(rows, QUERY_SCHEMA)
    return checked(checked(df, "eval_layer", EVAL_LAYERS), "expectation", EXPECTATIONS)


def regression_queries(queries: DataFrame) -> DataFrame:
    return queries.where(F.col("regression"))


def gold_edges(edges: DataFrame, register) -> DataFrame:
    """Gold contradictions of a YAML corpus, one per unordered pair; story by default."""
    rows = edges.where(F.col("edge_type") == "contradicts")
    pair = F.sort_array(F.array("src", "dst"))
    return rows.groupBy(pair.alias("pair")).agg(
        F.first("src").alias("src"), F.first("dst").alias("dst"), F.first(F.coalesce("relation_class", F.lit("story"))).alias("relation_class")
    ).select("src", "dst", "relation_class", register.alias("register"), F.lit("contradicts").alias("relation"))


def calibration_samples(spark: SparkSession, path: str | Path, expect: dict | None = None) -> DataFrame:
    """Samples with their manifest; provenance and counts must match."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    manifest, rows = raw.get("manifest", {}), raw.get("samples", [])
    for key, value in (expect or {}).items():
        if manifest.get(key) != value:
            raise SourceError(f"{key} is {manifest.get(key)!r}, expected {value!r}")
    if manifest.get("n_samples") != len(rows):
        raise SourceError(f"manifest counts {manifest.get('n_samples')} samples, file holds {len(rows)}")
    fields = [f.name for f in spark.createDataFrame([], SAMPLE_SCHEMA).schema]
    return checked(spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SAMPLE_SCHEMA), "relation", RELATIONS)


def node_config(path: str | Path) -> dict:
    """A node's own settings: id, peers in order, trust weights by peer and domain."""
    raw = _yaml(path)
    if not raw.get("node_id"):
        raise SourceError("node_id is missing")
    peers = [{"node": p["node_id"], "url": p["url"], "config_order": i} for i, p in enumerate(raw.get("peers") or [])]
    weights = [
        {"node": node, "domain": domain, "weight": float(w)}
        for node, table in (raw.get("trust_weights") or {}).items() for domain, w in (table or {}).items()
    ]
    return {"node_id": raw["node_id"], "peers": peers, "weights": weights, "threshold": float(raw.get("trust_threshold", 0.0))}


def chunks_with_outlets(chunks: DataFrame, documents: DataFrame, doc_id: str | None = None, exclude=("out_of_scope_stub",)) -> DataFrame:
    """Chunks joined to their documents, one document or all but the excluded."""
    rows = chunks.where(F.col("chunk_id").startswith(f"{doc_id}:")) if doc_id else chunks
    if exclude and not doc_id:
        rows = rows.where(~F.substring_index("chunk_id", ":", 1).isin(*exclude))
    return rows.join(documents.select("doc_id", "outlet", "title"), "doc_id")


def chunks_by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi")
