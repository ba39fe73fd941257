import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import calibration as K
from spanloom.operators import claims as C
from spanloom.operators import evaluation as E
from spanloom.operators import labels as L
from spanloom.operators import peers as P
from spanloom.operators import relations as X

EVIDENCE = [(0, "a", 1, "The river rose two metres overnight.", "n1"), (0, "b", 2, "Officials denied the river rose at all.", "n2")]


def evidence(spark):
    return spark.createDataFrame(EVIDENCE, "query_id bigint, chunk_id string, place int, text string, node string")


def test_claims_and_verdicts(spark):
    answers = spark.createDataFrame([(0, "River rose overnight [2]. Bees hum [9]. [1]")], "query_id bigint, answer string")
    sources = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "query_id bigint, number int, chunk_id string")
    claims = C.claims_from_answers(answers, sources)
    assert [(r.claim_text, r.cited) for r in claims.orderBy("claim_no").collect()] == [("River rose overnight .", ["b"]), ("Bees hum .", [])]
    got = {r.claim_no: r for r in C.verified(claims, evidence(spark)).collect()}
    assert (got[0].verdict, got[0].matched_chunk_id, got[0].node_scope) == ("SUPPORTED", "b", "within_node")     # 2/3 in the cited chunk
    assert (got[1].verdict, got[1].matched_chunk_id, got[1].score, got[1].node_scope) == ("UNSUPPORTED", None, 0.0, "none")


def test_exact_spans_are_supported_verbatim_and_scoped_by_citation(spark):
    rows = [(0, 1, "river ROSE  two", "EXACT", ["b", "a"]), (0, 2, "the river rose", "AMBIGUOUS", ["a", "b"]), (0, 3, "river sank", "EXACT", ["a"])]
    claims = spark.createDataFrame(rows, "query_id bigint, claim_no int, claim_text string, span_type string, cited array<string>")
    got = {r.claim_no: r for r in C.verified(claims, evidence(spark)).collect()}
    assert (got[1].matched_chunk_id, got[1].score, got[1].node_scope) == ("a", 1.0, "cross_node")
    assert (got[2].verdict, got[2].matched_chunk_id) == ("SUPPORTED", "a")       # a tie goes to the first citation
    assert (got[3].verdict, got[3].score, got[3].node_scope) == ("SUPPORTED", 0.5, "within_node")
    hold = C.all_citations_hold(claims.where("claim_no <= 2"), evidence(spark)).first()
    assert hold.verified is False


def test_empty_pools_give_null_metrics(spark):
    results = spark.createDataFrame(
        [("rag", 0, "q", "realism", None, "answerable", True, [], [], None, [])],
        "arm string, query_id bigint, query string, eval_layer string, eval_tag string, expectation string, refused boolean, retrieved array<string>, gold array<string>, counterfactual_answer string, pairs array<array<string>>",
    )
    claims = spark.createDataFrame([], "arm string, query_id bigint, claim_text string, verdict string, matched_chunk_id string, node_scope string, span_type string, cited array<string>")
    row = C.run_metrics(C.query_scores(results, claims)).where("eval_layer is null").first()
    assert row.n_claims == 0 and row.query_relevance_rate == 0.0 and row.failure_precision == 0.0
    for name in ("fabrication_rate", "attribution_coverage", "gold_chunk_coverage", "chunk_quotation_rate", "divergence_fidelity", "failure_recall", "counterfactual_adherence"):
        assert row[name] is None


# --- labels ----------------------------------------------------------------------

LOG = "seq bigint, ts string, src string, dst string, relation string, relation_class string"


def test_fold_is_latest_wins_in_any_order(spark):
    rows = [(1, "t1", "a", "b", "unrelated", None), (2, "t2", "b", "a", "corroborates", None), (3, "t2", "a", "b", "contradicts", "story"), (4, "t0", "a", "b", "supersedes", None)]
    for order in itertools.permutations(rows):
        assert [r.seq for r in L.folded(spark.createDataFrame(list(order), LOG)).collect()] == [3]
    twice = spark.createDataFrame(rows + rows, LOG).repartition(3)
    assert [r.seq for r in L.folded(twice).collect()] == [3]


def test_agreement_seeding_and_relabels(spark):
    one = spark.createDataFrame([(1, "t", "a", "b", "unrelated", None), (2, "t", "c", "d", "contradicts", "story")], LOG)
    two = spark.createDataFrame([(1, "t", "b", "a", "unrelated", None), (2, "t", "d", "c", "contradicts", "issue_frame"), (3, "t", "x", "y", "unrelated", None)], LOG)
    assert {(r.src, r.agrees) for r in L.agreement(one, two).collect()} == {("a", True), ("c", False)}
    assert [r.src for r in L.absent_from(two, one).collect()] == ["x"]
    assert [r.src for r in L.changed_against(two, one).collect()] == ["d"]


def test_story_band_keeps_both_ends(spark):
    rows = [(f"s{i:02d}", "z", i / 20, True) for i in range(20)]
    df = spark.createDataFrame(rows, "src string, dst string, p_contra double, same_story boolean")
    assert [r.src for r in L.story_band(df, cap=4).collect()] == ["s19", "s18", "s01", "s00"]
    assert L.story_band(df, cap=50).count() == 20


def test_residue_ranking_floats_close_contradictions(spark):
    rows = [("a", "z", 0.9, 0.1), ("b", "z", 0.8, 0.9), ("c", "z", 0.7, 0.95), ("d", "z", 0.4, 0.99), ("e", "z", 0.6, 0.99)]
    df = spark.createDataFrame(rows, "src string, dst string, cos double, p_contra double")
    got = [r.src for r in L.residue_ranking(df, ceiling=0.5, contra=0.5, nli_limit=3, cap=4).orderBy("position").collect()]
    assert got == ["c", "b", "a", "e"]       # e is past the NLI limit, d below the ceiling


def test_labelled_pairs_go_to_the_signals(spark):
    gold = spark.createDataFrame([(1, "t", "b", "a", "unrelated", None), (2, "t", "a", "c", "contradicts", "story")], LOG)
    signals = spark.createDataFrame(
        [("a", "b", 0.5, 0.5, True, None), ("b", "c", 0.9, 0.1, None, None)],
        "src string, dst string, cos double, p_contra double, same_story boolean, stance string")
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    out = L.calibration_rows(gold, texts, signals, gold.limit(0))
    assert {(r.src, r.dst, r.cos, r.drop_reason) for r in out.collect()} == {("b", "a", 0.5, None), ("a", "c", None, "text_unresolved")}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.src, r.dst) for r in L.backlog(signals, gold).collect()] == [("b", "c")]


def test_pairs_found_once_need_no_lookup(spark, tmp_path):
    """Scores with and without repeated ids equal those of a join on the pair."""
    from spanloom.plans import relating, scoring
    from spanloom.plans.registry import Tables

    words = [f"w{i}" for i in range(12)] + ["Union Yard", "Strike 42"]
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(words, k=8)), rng.choice("pq"), rng.choice(["en", "de"])) for i in range(14)]
    docs += [(i, f"Union Quillan 77 Brackwater w{i} w1", "p", "en") for i in (14, 15)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(12)] + [(14, 0, 0), (15, 1, 0)]
    vectors = [(i, [rng.random() for _ in range(4)], 0) for i in range(14)]
    for name, more_docs, more_labels in (("once", [], []), ("twice", [(3, "w1 w2 Strike 42 w5", "p", "de"), docs[5]], [(2, 1 - labels[2][1], 0), labels[7]])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs + more_docs, "doc_id bigint, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels + more_labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
        t = Tables(spark, folder)
        once, several = relating.split_signals(t)
        signals = relating.signals(t).cache()
        gold = scoring.gold_pairs(t, signals)
        assert (several.count() > 0) == (name == "twice") and once.count() + several.count() == signals.count()
        typed = signals.select("src", "dst", F.coalesce("same_story", F.lit(False)).alias("typed"))
        both = gold.withColumn("gold", F.col("relation") == "contradicts").join(typed, ["src", "dst"])
        assert str(scoring.typed_scores(t).first()) == str(E.typed_scores(both).first())      # may be NaN
        assert scoring.typed_scores(t).first().tp > 0
        if name == "once":      # which of several proposals of a pair counts is open
            want = E.gold_scores(scoring.X_seq(X.assessed(signals)), gold)
            assert sorted(scoring.gold_scores(t).collect(), key=str) == sorted(want.collect(), key=str)


# --- calibration -----------------------------------------------------------------

RELATIONS = ("contradicts", "corroborates", "related_untyped", "unrelated")


def grid_search(samples):
    cuts = lambda vs: [min(vs) - 1e-6, *[(a + b) / 2 for a, b in zip(sorted(set(vs)), sorted(set(vs))[1:])], max(vs) + 1e-6]
    cos, p = [s[0] for s in samples], [s[1] for s in samples]
    far = lambda x, vs: round(min(abs(x - v) for v in vs), 9)
    best = None
    for g, c, k in itertools.product(cuts(cos), cuts(cos), cuts(p)):
        if c >= g:
            right = sum(K.predicted(*s[:3], g, c, k) == s[3] for s in samples)
            key = (right, round(far(g, cos) + far(c, cos) + far(k, p), 9), -g, -c, -k)
            best = key if best is None or key > best else best
    return -best[2], -best[3], -best[4], best[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_calibration_equals_the_full_grid(spark, seed):
    rng = random.Random(seed)
    samples = [(round(rng.random(), 2), round(rng.random(), 1), rng.choice([True, False, None]), rng.choice(RELATIONS)) for _ in range(25)]
    df = spark.createDataFrame(samples, "cos double, p_contra double, same_story boolean, relation string")
    row = K.calibrated(df).first()
    assert (row.gate, row.ceiling, row.contra, row.n_right) == pytest.approx(grid_search(samples))


@pytest.mark.parametrize("seed, n, grain", [(1, 14, 2), (2, 14, 1), (3, 2, 1), (4, 1, 1)])
def test_every_fold_equals_the_full_grid(spark, seed, n, grain):
    """Values held by one sample alone and by several, ties, and folds without any sample."""
    rng = random.Random(seed)
    samples = [(round(rng.random(), grain), round(rng.random(), 1), rng.choice([True, False, None]), rng.choice(RELATIONS)) for _ in range(n)]
    samples += samples[: n // 5]
    df = spark.createDataFrame(samples, "cos double, p_contra double, same_story boolean, relation string")
    folds = {(r.cos, r.p_contra, r.same_story, r.relation): r for r in K.leave_one_out(df).collect()}
    assert len(folds) == len(set(samples))
    for i, s in enumerate(samples):
        rest = samples[:i] + samples[i + 1:]
        g, c, k = grid_search(rest)[:3] if rest else K.DEFAULTS
        got = folds[s]
        assert (got.gate, got.ceiling, got.contra) == pytest.approx((g, c, k))
        assert got.weight == samples.count(s) and got.predicted == K.predicted(*s[:3], g, c, k)


# --- peers -----------------------------------------------------------------------


def test_trust_gate(spark):
    rows = [("p", ["a", "b"], {"a": 0.4}), ("q", ["b"], {"a": 0.1}), ("r", [], {"a": 0.0}), ("s", None, {})]
    df = spark.createDataFrame(rows, "n string, d array<string>, w map<string,double>")
    got = {r.n: r.ok for r in df.select("n", P.trusted(F.col("d"), F.col("w"), 0.5).alias("ok")).collect()}
    assert got == {"p": False, "q": True, "r": True, "s": True}


def test_routing_stops_at_the_first_answer(spark):
    local = spark.createDataFrame([(0, False, None), (1, True, None), (2, True, "low"), (3, True, None)], "query_id bigint, refused boolean, reason string")
    ranked = spark.createDataFrame([(q, n, r) for q in (1, 2) for r, n in enumerate("abc", 1)], "query_id bigint, node string, rank int")
    outcomes = spark.createDataFrame([(1, "b", "answer"), (1, "c", "answer"), (1, "a", "refused"), (2, "a", "no")], "query_id bigint, node string, status string")
    got = {r.query_id: r for r in P.routed(local, ranked, outcomes).collect()}
    assert (got[0].refused, got[0].was_routed, got[0].attempted) == (False, False, [])
    assert (got[1].source_node, got[1].attempted, got[1].reasons) == ("b", ["a", "b"], ["local=zero_cursors", "a=refused"])
    assert got[2].refused and got[2].reasons == ["local=low", "a=no", "b=unreachable", "c=unreachable"]
    assert got[3].refused and not got[3].was_routed


def test_summaryless_peers_follow_in_configured_order(spark):
    queries = spark.createDataFrame([(0, "ferry", [1.0, 0.0])], "query_id bigint, query string, query_vector array<double>")
    peers = spark.createDataFrame([("n1", 0), ("n2", 1), ("zz", 2), ("aa", 3)], "node string, config_order bigint")
    centroids = spark.createDataFrame([("n1", [0.0, 1.0]), ("n2", [1.0, 0.0])], "node string, centroid array<double>")
    terms = spark.createDataFrame([("n2", "ferry", 2.0)], "node string, term string, idf double")
    got = P.ranked_peers(queries, peers, centroids, terms).orderBy("rank").collect()
    assert [r.node for r in got] == ["n2", "n1", "zz", "aa"]


def test_noise_cases_count_every_query_of_an_edge(spark):
    from spanloom.operators import evaluation as E

    scores = [(1, "a", 0.5), (2, "a", 0.01), (None, "a", 0.9), (1, "b", 0.2), (2, "b", 0.9), (None, "b", 0.9), (1, "c", 0.9)]
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("c", "x")]
    chunks = [("a", "n", "en"), ("b", "n", "en"), ("c", "s", "en"), ("d", None, "de")]
    rows = E.noise_cases(
        spark.createDataFrame(scores, "query_id bigint, chunk_id string, relevance double"), spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame(chunks, "chunk_id string, outlet string, eval_layer string"), 0.13,
    )
    kind, score = {c[0]: c for c in chunks}, {s[:2]: s[2] for s in scores}
    want = {}
    for src, dst in edges:
        for q, c, r in scores:
            if c == src and dst in kind:
                a, b = kind[src], kind[dst]
                name = "C" if a[2] != b[2] else "E" if a[1] == b[1] else "A"
                forced = r >= 0.13 and q is not None and score.get((q, dst), 0) >= 0.13
                want[name, forced] = want.get((name, forced), 0) + 1
    got = {}
    for r in rows.collect():
        got[r.noise_class, r.forced] = got.get((r.noise_class, r.forced), 0) + r.n
    assert got == want
    by_class = {r.noise_class: (r.n, r.forced_divergent, r.correct) for r in E.stress_scores(rows).collect()}
    told = lambda name, n=lambda f: True: sum(v for (c, f), v in want.items() if c == name and n(f))
    assert by_class == {c: (told(c), told(c, lambda f: f), told(c, lambda f: f == (c == "E"))) for c, _ in want}  # noqa: B023


def test_story_band_reads_the_pairs_once(spark):
    df = spark.createDataFrame([(f"s{i % 7}", f"t{i:02d}", 0.1 * (i % 5), i % 3 > 0) for i in range(40)], "src string, dst string, p_contra double, same_story boolean")
    want = sorted((-r.p_contra, r.src, r.dst) for r in df.collect() if r.same_story)
    low = sorted(sorted(want, key=lambda r: (r[1], r[2]), reverse=True), key=lambda r: -r[0])
    for cap in (5, 8):
        got = [(-r.p_contra, r.src, r.dst) for r in L.story_band(df, cap=cap).collect()]
        assert got == sorted(set(want[: cap // 2]) | set(low[: cap - cap // 2]))
    plan = L.story_band(df, cap=8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("again", [False, True])
def test_lone_pairs_get_the_codes_of_the_whole_gate(spark, tmp_path, again):
    from spanloom.operators import scan as N
    from spanloom.plans import curation, relating
    from spanloom.plans.registry import Tables

    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["Union Yard", "Strike 42"]
    docs = [(i, " ".join(rng.choices(words, k=8)), "p", rng.choice(["en", "de"])) for i in range(12)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(10)]
    vectors = [(i, [rng.random() for _ in range(4)], 0) for i in range(12)]
    if again:
        docs, labels = docs + [docs[2]], labels + [labels[4], (5, 1 - labels[5][1], 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    t = Tables(spark, folder)
    signals = relating.signals(t).cache()
    proposed = N.proposals(signals, t.chunks)
    whole = lambda more: sorted(map(tuple, N.admitted_scan(proposed, t.chunks, more).select("src", "dst", "code").distinct().collect()))
    got = lambda rows: sorted(map(tuple, rows.select("src", "dst", "code").distinct().collect()))
    assert got(relating.scan_codes(t)) == whole(None) != []
    if not again:
        scores = relating.scan_entailment(signals).select("src", "dst", "entail_ab", "entail_ba")
        assert got(relating.scan_codes(t, relating.scan_entailment)) == whole(scores)
    quality = t.table("labels").select(F.col("doc_id").cast("string").alias("src"), "quality")
    assert curation.samples(t).count() == signals.join(quality, "src", "left").count()
