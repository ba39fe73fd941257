import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import digests as G
from spanloom.operators import divergence as V
from spanloom.operators import retrieval as R
from spanloom.operators import synthesis as S

CHUNKS = [
    ("c1", "d1", "north", "Wildfire smoke reached the valley. Crews thank volunteers."),
    ("c2", "d2", "south", "Wildfires burned the valley. The mayor left."),
    ("c3", "d3", "south", "The district school opened. A district vote is due."),
    ("c4", "d4", "north", "The district turnout rose in the election."),
    ("c5", "d5", "east", "Ferries stopped after the storm."),
]
SCHEMA = "chunk_id string, doc_id string, outlet string, text string"


def table(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA).withColumn("eval_layer", F.lit("realism"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


@pytest.mark.parametrize("n, k", [(30, 4), (3, 5)])
def test_dense_legs_match_brute_force(spark, n, k):
    rng = np.random.default_rng(5)
    corpus, queries = rng.integers(-2, 3, (n, 4)).astype(float), rng.integers(-2, 3, (6, 4)).astype(float)
    vectors = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(corpus)], "chunk_id string, vector array<double>").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, query_vector array<double>")
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    sims = np.round(unit(queries) @ unit(corpus).T, 6)
    want = {(i, f"v{j:02d}", r) for i in range(6) for r, j in enumerate(sorted(range(n), key=lambda j: (-sims[i, j], j))[:k], 1)}
    got = {(r.query_id, r.chunk_id, r.dense_rank) for r in R.dense_leg(q, vectors, k).collect()}
    assert got == want
    blocked = R.dense_candidates_blocked(q, vectors, k, query_block=2, slice_rows=7)
    ranked = R.top_per_query(blocked, k, F.col("similarity").desc(), F.col("chunk_id"))
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in ranked.collect()} == want


def test_conjunctive_leg_needs_every_term(spark):
    got = R.lexical_leg(asked(spark, "wildfire valley", "wildfire school", "absentword valley"), table(spark), 5).collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == [(0, "c1"), (0, "c2")]
    some = R.lexical_leg(asked(spark, "wildfire school"), table(spark), 5, require_all=False).collect()
    assert {r.chunk_id for r in some} == {"c1", "c2", "c3"}


def test_fusion_adds_both_ranks_and_breaks_ties_by_id(spark):
    dense = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id bigint, chunk_id string, dense_rank int")
    sparse = spark.createDataFrame([(0, "b", 1), (0, "c", 2), (0, "d", 1)], "query_id bigint, chunk_id string, sparse_rank int")
    got = [(r.chunk_id, r.rrf_score) for r in R.fuse(dense, sparse, 3).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("d", round(1 / 61, 9))]


def test_floors_and_zero_drop(spark):
    hits = spark.createDataFrame([(0, "a", 0.9, 0.0), (0, "b", 0.7, 0.5), (0, "c", 0.5, 0.0), (1, "a", 0.2, 0.0)], "query_id bigint, chunk_id string, rrf_score double, sentence_score double")
    assert {(r.query_id, r.chunk_id) for r in R.within_delta(hits, 0.25).collect()} == {(0, "a"), (0, "b"), (1, "a")}
    assert R.within_delta(hits, 0).count() == 4
    assert {(r.query_id, r.chunk_id) for r in R.drop_irrelevant(hits).collect()} == {(0, "b"), (1, "a")}
    status = {r.query_id: r.refusal_reason for r in R.confidence_status(asked(spark, "x", "y", "z"), hits, 0.5).collect()}
    assert status == {0: None, 1: "low_confidence", 2: "low_confidence"}


def test_relevance_favours_the_distinctive_word(spark):
    q = asked(spark, "wildfire district")
    got = {r.chunk_id: r.relevance for r in R.relevance_everywhere(table(spark), q).collect()}
    assert set(got) == {"c1", "c2", "c3", "c4"} and all(0 < v <= 1 for v in got.values())
    members = table(spark).withColumn("query_id", F.lit(0).cast("bigint"))
    few = {r.chunk_id: r.relevance for r in R.relevance_of(members, R.weighted_query_terms(q, table(spark))).collect()}
    assert few == got


EDGES = [("c1", "c2", "contradicts"), ("c3", "c4", "contradicts"), ("c1", "c5", "cites"), ("c2", "c9", "contradicts"), ("c1", "c3", "supersedes")]


def bundle(spark, query, ids):
    hits = spark.createDataFrame([(0, c, i, None, round(1 / (60 + i), 9)) for i, c in enumerate(ids, 1)], "query_id bigint, chunk_id string, dense_rank int, sparse_rank int, rrf_score double")
    hits = hits.withColumn("rank", F.col("dense_rank"))
    edges = spark.createDataFrame(EDGES, "src string, dst string, edge_type string")
    return S.evidence_bundle(asked(spark, query), table(spark), edges, hits)


def test_contradiction_through_a_neighbour_makes_the_bundle_divergent(spark):
    b = bundle(spark, "wildfire valley", ["c1", "c3"])
    assert b.mode.first().mode == "divergent"
    order = [r.chunk_id for r in b.hits.orderBy("position").collect()]
    assert order[:2] == ["c1", "c2"] and "c3" not in order
    scores = {r.chunk_id: r.rrf_score for r in b.hits.collect()}
    assert scores["c1"] == round(1 / 61 + 0.05, 9) and scores["c2"] == 0.05
    assert {(r.src, r.dst) for r in b.edges.collect()} == {("c1", "c2"), ("c1", "c5")}      # c9 is unknown


def test_off_query_contradiction_stays_convergent(spark):
    b = bundle(spark, "ferries storm", ["c5", "c3"])
    assert b.mode.first().mode == "convergent"
    assert {(r.src, r.edge_type) for r in b.pairs.collect()} == {("c1", "cites")}


def test_divergence_zones_and_quotes(spark):
    texts = {"x": "Shared opening line here. The fire burned 40 homes in town. We thank all.", "y": "Shared opening line here. The fire burned 12 homes in town. Mayor spoke."}
    hits = spark.createDataFrame([(0, c, i, t) for i, (c, t) in enumerate(texts.items(), 1)], "query_id bigint, chunk_id string, position int, text string")
    pairs = spark.createDataFrame([(0, "x", "y", "contradicts")], "query_id bigint, src string, dst string, edge_type string")
    rows = V.sentence_rows(hits)
    zones = V.divergence_starts(rows, pairs)
    assert {(r.chunk_id, r.position) for r in zones.collect()} == {("x", 1), ("y", 1)}
    assert {(r.chunk_id, r.position) for r in V.shared_starts(rows).collect()} == {("x", 0), ("y", 0)}
    closed = V.forbidden_starts(rows, zones)
    assert {(r.chunk_id, r.position) for r in closed.collect()} == {("x", 2), ("y", 2)}
    q = asked(spark, "fire homes")
    scores = V.start_scores(rows, q)
    mode = spark.createDataFrame([(0, "divergent")], "query_id bigint, mode string")
    said = V.quoted_answers(hits, rows, scores, pairs, mode, zones, closed).orderBy("span_no").collect()
    assert [(r.text, r.span_type, r.cited) for r in said] == [
        ("The fire burned 40 homes in town.", "EXACT", ["x"]), ("The fire burned 12 homes in town.", "EXACT", ["y"]),
    ]
    calm = mode.withColumn("mode", F.lit("convergent"))
    one = V.quoted_answers(hits, rows, V.start_scores(rows, asked(spark, "shared opening")), pairs.limit(0), calm, zones.limit(0), closed.limit(0)).collect()
    assert [(r.text, r.span_type, r.cited) for r in one] == [("Shared opening line here.", "AMBIGUOUS", ["x", "y"])]


def leaves(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content_hash string, outlet string, title string")


def test_anchor_digests_ignore_order_and_find_one_change(spark):
    rows = [(f"d:{i}", f"h{i}", 'o"x', "té") for i in range(200)]
    shuffled = random.Random(1).sample(rows, len(rows))
    digest = lambda r: {x.bucket: x.bucket_hash for x in G.bucket_digests(leaves(spark, r)).collect()}
    assert digest(rows) == digest(shuffled)
    changed = [(*rows[0][:1], "new", *rows[0][2:]), *rows[1:]]
    stale = G.mismatched_buckets(G.bucket_digests(leaves(spark, rows)), G.bucket_digests(leaves(spark, changed)))
    assert stale.count() == 1
    synced = G.synced_anchors(leaves(spark, rows), leaves(spark, changed), stale)
    assert digest([tuple(r) for r in synced.collect()]) == digest(changed)
    assert digest([])[3] == G.EMPTY_BUCKET and len(digest([])) == 16
    kinds = {(r.chunk_id, r.change) for r in G.anchor_diff(leaves(spark, rows[:2]), leaves(spark, [("d:0", "new", 'o"x', "té"), ("d:9", "h", "o", "t")])).collect()}
    assert kinds == {("d:0", "changed"), ("d:1", "removed"), ("d:9", "added")}


def plain_tree(cells, stop):
    """{path: digest} of (key, item) cells by the documented format."""
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = {}
    for key, item in sorted(cells):
        level.setdefault(sha(key)[:4], []).append(item)
    for width in range(3, stop - 2, -1):
        digests = sorted((path, sha("|".join(items))) for path, items in level.items())
        if width < stop:
            return dict(digests)
        level = {}
        for path, digest in digests:
            level.setdefault(path[:width], []).append(digest)


def test_bucket_digest_is_the_documented_encoding(spark):
    import hashlib
    import json

    rows = [(f"d:{i}", f"h{i}", 'o"\\', "té 😀") for i in range(30)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = plain_tree([(r[0], sha(json.dumps(list(r)))) for r in rows], 1)
    want = {b: top.get(f"{b:x}", sha("empty")) for b in range(16)}
    assert {r.bucket: r.bucket_hash for r in G.bucket_digests(leaves(spark, rows)).collect()} == want
    assert G.corpus_fingerprint(leaves(spark, rows)).first().content_hash == plain_tree([(r[0], f"{r[0]}:{r[1]}") for r in rows], 0)[""][:16]


def test_one_row_changes_one_bucket_at_any_size(spark):
    rows = [(f"d:{i}", f"h{i}", "o", "t") for i in range(1100)]
    for n in (0, 1, 15, 16, 17, 62, 64, 255, 256, 1023, 1025):
        here, there = (dict(G.bucket_digests(leaves(spark, r)).select("bucket", "bucket_hash").collect()) for r in (rows[:n], rows[: n + 1]))
        assert sum(here[b] != there[b] for b in here) == 1
    print_ = lambda r: tuple(G.corpus_fingerprint(leaves(spark, r)).first())
    assert print_(rows) == print_(rows[::-1]) and print_(rows)[0] == 1100 and print_(rows)[1] != print_(rows[1:])[1]


def test_retrieval_manifest_hashes_the_canonical_json(spark):
    import hashlib
    import json

    from spanloom.operators import ingest as N

    b = bundle(spark, "wildfire valley é", ["c1", "c3"])
    got = N.retrieval_manifests(asked(spark, "wildfire valley é"), b, table(spark).withColumn("title", F.lit('t"é'))).first()
    outlets = {c: o for c, _, o, _ in CHUNKS}
    entries = [
        {"chunk_id": r.chunk_id, "outlet": outlets[r.chunk_id], "title": 't"é', "dense_rank": r.dense_rank, "sparse_rank": r.sparse_rank, "rrf_score": r.rrf_score}
        for r in b.hits.orderBy("position").collect()
    ]
    body = {"query": "wildfire valley é", "query_hash": hashlib.sha256("wildfire valley é".encode()).hexdigest(),
            "synthesis_mode": "divergent", "edge_types": ["cites", "contradicts"], "entries": entries}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got.manifest_hash == want and got.n_entries == len(entries)


@pytest.mark.parametrize("matched", [4, 2_000_000])
def test_chunks_are_scored_against_all_queries_in_place(spark, monkeypatch, matched):
    """The same as a join on terms, with repeated and null ids, in pieces of any size."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["fox", "crow", "heron", "otter", "vole", "wren"]) for _ in range(n))
    rows = [(f"c{i % 9}" if i else None, ". ".join(say(rng.randint(1, 4)) for _ in range(3)) + ".") for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame([(1, "fox crow"), (1, "vole"), (2, "otter heron"), (None, "wren fox"), (4, "absentword")], "query_id bigint, query string")
    monkeypatch.setattr(R, "MATCHED", matched)
    scores = R.relevance_everywhere(chunks, q)
    best = R.lexical_leg(q, chunks, 3, require_all=False)
    assert "MapInArrow" in scores._jdf.queryExecution().executedPlan().toString()
    got, top = sorted(map(tuple, scores.collect()), key=str), sorted(map(tuple, best.collect()), key=str)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    assert got == sorted(map(tuple, R.relevance_everywhere(chunks, q).collect()), key=str)
    assert top == sorted(map(tuple, R.lexical_leg(q, chunks, 3, require_all=False).collect()), key=str)


def test_blunt_mode_ranks_the_corpus_once(spark, tiny, monkeypatch):
    from spanloom.plans import search
    from spanloom.plans.registry import Tables

    scans, real = [], R.term_counts
    monkeypatch.setattr(R, "term_counts", lambda *a: scans.append(1) or real(*a))
    assert search.blunt_mode(Tables(spark, tiny)).count() > 0
    assert len(scans) == 1


def test_many_queries_meet_the_corpus_in_wide_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(rng.normal(size=(30, 4)))], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], "query_id bigint, query_vector array<double>")
    monkeypatch.setattr(R, "SIMILARITIES", 64)
    want = sorted(map(tuple, R.top_per_query(R.dense_candidates(q, vectors, 3), 3, F.col("similarity").desc(), F.col("chunk_id")).collect()))
    blocked = R.dense_candidates_blocked(q, vectors, 3, query_block=2, slice_rows=100, wide_block=10**6)
    assert sorted(map(tuple, R.top_per_query(blocked, 3, F.col("similarity").desc(), F.col("chunk_id")).collect())) == want
    cores = spark.sparkContext.defaultParallelism
    assert f"{2 * cores - 1}" in blocked._jdf.queryExecution().logical().toString() and "199)" not in blocked._jdf.queryExecution().logical().toString()
