"""A corpus from raw documents to a mix: five stages, each one operator's decisions.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
documents.  What each does with odd rows is its operator's defined result:

* null and empty texts fail the quality base rules and go in the first stage; when a
  later stage is run by itself, they have no lines, no near duplicates and no
  benchmark words, and stay;
* rows that repeat a doc_id are one document and stay or go together; a null doc_id
  is a document of its own in every row;
* extra columns are carried along, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import contamination, lines, mixing, near, quality
from spanloom.llm.common import table


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with columns the operators don't know renamed out of the way, and how
    to select the old ones from the renamed."""
    known = ("doc_id", "text", "lang", "source", "n_chars")
    names = {c: c if c in known else f"__extra{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(new).alias(old) for old, new in names.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    plain, old = _apart(docs)
    judged = quality.judged(plain, table(spark, sf_dir, "labels"))
    kept = judged.where("kept").select(F.col("doc_id").alias("__d"), F.col("version").alias("__v")).distinct()
    return plain.join(
        kept, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__v")), "left_semi"
    ).select(old)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines within one edit of an earlier line; n_chars follows, and a
    document none of whose lines is left goes."""
    plain, old = _apart(docs)
    cleaned = lines.deduplicated(plain).where("n_lines = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        cleaned = cleaned.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return cleaned.select(old)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every group of near duplicates (five-word shingles, 0.8)."""
    plain, old = _apart(docs)
    gone = near.grouped(plain, width=5, similarity=80).where("NOT kept").select(F.col("doc_id").alias("__d")).distinct()
    return plain.join(gone, F.col("doc_id") == F.col("__d"), "left_anti").select(old)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    plain, old = _apart(docs)
    judged = contamination.contaminated(plain, table(spark, sf_dir, "benchmark"))
    return judged.where("NOT contaminated").select(old)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document left."""
    return mixing.mix(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Quality rules and the mix are fitted, which SQL can't express; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
