"""Cheap registered queries against their SQL on the smallest data."""

import oracle_check
import pytest

import __spark_entry__ as entry

CHEAP = (
    "token_stats", "corpus_idf", "corpus_fingerprint", "anchor_diff", "idf_relevance_topk", "rrf_fusion", "story_pairs",
    "admission_codes", "verified_claims", "label_fold", "dataset_rows", "divergence_zones", "document_upsert", "route_first_success",
)


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, tiny, name):
    con = oracle_check.connect(tiny)
    assert oracle_check.compare(spark, tiny, name, entry.queries(), entry.oracle_sql(), con)[1] == "ok"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_anchors_never_read_text_columns_they_do_not_hash(spark, tiny):
    from spanloom.plans.registry import Tables

    plan = Tables(spark, tiny).anchors.select("chunk_id", "outlet")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", ["story_pairs", "related_pairs", "lexical_topk_all", "idf_relevance_topk", "bundle_hits", "verified_claims", "run_metrics"])
def test_no_cross_product_in_the_plan(spark, tiny, name):
    plan = entry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
