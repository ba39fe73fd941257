"""The pipeline's stages, each on its own input."""

import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

ROWS = plain.corpus(11)
NAMES = [n for n, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, plain.SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    extra = spark.createDataFrame([(ROWS[0][0], *ROWS[0][1:], 5), (None, "a text without an id", "x", "s0", 1), (None, None, None, None, None)],
                                  frame.schema)
    return frame.union(extra).withColumns({n: F.lit(n) for n in ("kept", "items", "version", "w", "n_words", "copies", "__d")})


def test_order():
    assert NAMES == ["quality rules", "line dedup", "near dedup", "decontamination", "mixing"]


@pytest.mark.parametrize("place", range(4))
def test_stages_keep_the_columns(spark, docs, tiny, place):
    stage = corpus_pipeline.STAGES[place][1]
    out = stage(spark, docs, tiny)
    assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
    assert 0 < out.count() <= docs.count()
    assert stage(spark, docs.limit(0), tiny).count() == 0


def test_near_stage_keeps_one_of_each_group(spark, docs, tiny):
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, tiny).collect()]
    want = [i for i, (_, _, k) in plain.near([r[:2] for r in ROWS], 5).items() if k]
    assert sorted(set(kept) - {None}) == want and kept.count(None) == 2


def test_line_stage_rebuilds_texts(spark, docs, tiny):
    out = corpus_pipeline.line_dedup(spark, docs.where("doc_id > 0"), tiny).collect()
    want = plain.line_dedup([r[:2] for r in ROWS if r[0] > 0])
    for r in out:
        assert r["text"] == want[r["doc_id"]] and (r["text"] is None or r["n_chars"] == len(r["text"]))
    gone = {r[0] for r in ROWS if r[0] > 0} - {r["doc_id"] for r in out}
    assert gone and all(not (want[i] or "").strip() for i in gone)


def test_run_equals_its_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, tiny)
    left = {r[0] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, tiny).collect()
    assert {r["doc_id"] for r in out} == left
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in out)
