"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores, BENCH_QUERIES (optional,
comma-separated) other queries than the headline ones.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spanloom.plans import catalog  # noqa: E402
from spanloom.session import local_session  # noqa: E402

HEADLINE = (
    "token_stats", "corpus_idf", "content_groups", "merkle_buckets", "anchor_sync_plan", "peer_terms",
    "idf_relevance_topk", "dense_topk", "lexical_topk_all", "rrf_fusion", "bundle_hits", "extractive_answers",
    "story_pairs", "relation_assessments", "corpus_scan", "admission_codes", "verified_claims", "run_metrics",
    "label_fold", "dataset_rows", "divergence_zones", "calibrated_thresholds", "rank_peers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
