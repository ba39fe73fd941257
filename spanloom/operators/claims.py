"""Claims: splitting answers, verifying them against evidence, scoring runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
SUPPORT_THRESHOLD = 0.5
RELEVANCE_SHARE = 0.20
EXTRACTIVE = ("EXACT", "AMBIGUOUS")
DIVERGENCE_TAGS = (
    "incident_divergence", "election_divergence", "emissions_divergence", "wildfire_divergence",
    "water_divergence", "revenue_divergence", "breach_divergence", "rezoning_divergence",
    "habitability_divergence",
)


def claim_number(part: Column, position: Column) -> Column:
    """A sentence's number: its part's (an answer, a turn) above its place in it."""
    return F.shiftleft(part.cast("bigint"), 20) + position


def claims_from_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One GENERATED claim per non-empty sentence of answers(query_id, answer).

    A query may have several answers, told apart by ``answer_no``, which then
    counts in the high bits of claim_no.
    ``sources`` (query_id, number, chunk_id) resolves citation numbers; unknown
    numbers are dropped and citation order is kept.
    """
    if "answer_no" not in answers.columns:
        answers = answers.withColumn("answer_no", F.lit(0))
    parts = answers.select(
        "query_id", "answer_no", F.posexplode(T.plain_sentences(F.col("answer"))).alias("position", "sentence")
    ).withColumn("claim_no", claim_number(F.col("answer_no"), F.col("position")))
    claims = parts.select(
        "query_id", "claim_no",
        T.without_citations(F.col("sentence")).alias("claim_text"),
        T.citation_numbers(F.col("sentence")).alias("numbers"),
    ).where(F.col("claim_text") != "")
    cited = (
        claims.select("query_id", "claim_no", F.posexplode("numbers").alias("order", "number"))
        .join(sources, ["query_id", "number"])
        .groupBy("query_id", "claim_no")
        .agg(F.array_sort(F.collect_list(F.struct("order", "chunk_id"))).alias("cells"))
        .select("query_id", "claim_no", F.transform("cells", lambda c: c["chunk_id"]).alias("cited"))
    )
    return claims.join(cited, ["query_id", "claim_no"], "left").select(
        "query_id", "claim_no", "claim_text", F.lit("GENERATED").alias("span_type"),
        F.coalesce("cited", F.array().cast("array<string>")).alias("cited"),
    )


def _support(wanted: Column, score: Column, place: Column) -> Column:
    """Best positive score among wanted rows; the earliest place wins ties."""
    rank = F.struct(score.alias("score"), (-place).alias("early"))
    return F.max(F.when(wanted & (score > 0), F.struct(rank.alias("rank"), F.col("chunk_id"))))


def verified(
    claims: DataFrame, evidence: DataFrame, score: Column | None = None, threshold: float = SUPPORT_THRESHOLD,
) -> DataFrame:
    """Verdict, matched chunk and score of each claim.

    evidence: query_id, chunk_id, place, text, node.  ``score`` may be any Column
    over claim_text and text (an entailment UDF, say); word overlap by default.
    """
    scored = score if score is not None else T.word_share(F.col("mine"), F.col("theirs"))
    told = claims.withColumns({"mine": T.claim_words(F.col("claim_text")), "flat_claim": T.squeezed(F.col("claim_text"))})
    seen = evidence.withColumns({"theirs": F.array_distinct(T.claim_words(F.col("text"))), "flat_text": T.squeezed(F.col("text"))})
    rows = (
        told.join(seen, "query_id", "left")
        .withColumn("cite_place", F.array_position("cited", F.col("chunk_id")).cast("int"))
        .withColumn("is_cited", F.coalesce(F.col("cite_place") > 0, F.lit(False)))
        .withColumn("score", F.round(F.coalesce(scored, F.lit(0.0)), 9))
        .withColumn(
            "verbatim",
            F.col("is_cited") & (F.col("span_type") == "EXACT")
            & (F.col("flat_claim") != "") & F.contains("flat_text", "flat_claim"),
        )
    )
    keys = ["query_id", "claim_no"]
    kept = [c for c in claims.columns if c not in keys]
    best = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in kept],
        F.min_by(F.when(F.col("verbatim"), F.col("chunk_id")), F.when(F.col("verbatim"), F.col("cite_place"))).alias("exact"),
        _support(F.col("is_cited"), F.col("score"), F.col("cite_place")).alias("from_cited"),
        _support(F.lit(True), F.col("score"), F.col("place")).alias("from_all"),
        F.collect_set(F.when(F.col("is_cited"), F.col("node"))).alias("cited_nodes"),
        F.collect_set(F.struct("chunk_id", "node")).alias("nodes"),
    )
    cited_ok = F.coalesce(F.col("from_cited.rank.score") >= threshold, F.lit(False))
    pick = F.when(cited_ok, F.col("from_cited")).otherwise(F.col("from_all"))
    supported = F.coalesce(pick["rank"]["score"] >= threshold, F.lit(False))
    exact = F.col("exact").isNotNull()
    judged = best.select(
        *keys, *kept,
        F.when(exact | supported, "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"),
        F.when(exact, F.col("exact")).when(supported, pick["chunk_id"]).alias("matched_chunk_id"),
        F.when(exact, F.lit(1.0)).otherwise(F.coalesce(pick["rank"]["score"], F.lit(0.0))).alias("score"),
        "cited_nodes", "nodes",
    )
    matched_node = F.filter("nodes", lambda n: n["chunk_id"] == F.col("matched_chunk_id"))
    grounds = F.when(F.col("span_type").isin(*EXTRACTIVE), F.size("cited_nodes")).otherwise(
        F.when(F.col("matched_chunk_id").isNotNull(), F.size(matched_node)).otherwise(F.lit(0))
    )
    return judged.withColumn("node_scope", node_scope(grounds)).drop("nodes", "cited_nodes")


def node_scope(n_nodes: Column) -> Column:
    return F.when(n_nodes == 0, "none").when(n_nodes == 1, "within_node").otherwise("cross_node")


def all_citations_hold(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Per query: every claim cites something and is found in every chunk cited."""
    cited = claims.select("query_id", "claim_no", "claim_text", F.explode_outer("cited").alias("chunk_id"))
    held = F.coalesce(
        F.contains(T.squeezed(F.col("text")), T.squeezed(F.col("claim_text"))), F.lit(False)
    )
    return cited.join(texts.select("chunk_id", "text"), "chunk_id", "left").groupBy("query_id").agg(
        F.bool_and(held).alias("verified")
    )


def refusal_gates(queries: DataFrame, claims: DataFrame, evidence: DataFrame, floor: float = RELEVANCE_SHARE) -> DataFrame:
    """Per query: does the evidence, and does any claim, bear on the question?"""
    asked = queries.select("query_id", "query", "gold")
    seen = asked.join(evidence, "query_id").groupBy("query_id").agg(
        (F.max(T.overlap_share(F.col("query"), F.col("text"))) >= floor).alias("evidence_relevant")
    )
    on_topic = (T.overlap_share(F.col("claim_text"), F.col("query")) >= floor) | T.shares_keyword(
        F.col("claim_text"), F.col("query")
    )
    said = asked.join(claims, "query_id").groupBy("query_id").agg(
        F.max(on_topic).alias("claims_relevant"),
        F.max((F.size("gold") == 0) | F.arrays_overlap("gold", "cited")).alias("cites_gold"),
    )
    no = F.lit(False)
    return asked.join(seen, "query_id", "left").join(said, "query_id", "left").select(
        "query_id",
        F.coalesce("evidence_relevant", no).alias("evidence_relevant"),
        F.coalesce("claims_relevant", no).alias("claims_relevant"),
        F.coalesce("cites_gold", F.size("gold") == 0).alias("cites_gold"),
    )


# --- run metrics -------------------------------------------------------------


def query_scores(results: DataFrame, claims: DataFrame) -> DataFrame:
    """Counts per (arm, query_id) that every run metric is a ratio of.

    results: arm, query_id, query, eval_layer, eval_tag, expectation, refused,
    retrieved, gold (arrays), counterfactual_answer, pairs (array of arrays).
    claims: arm, query_id, claim_text, verdict, matched_chunk_id, node_scope,
    span_type, cited.
    """
    facts = results.select("arm", "query_id", "gold", "counterfactual_answer", T.claim_words(F.col("query")).alias("asked"))
    graded = F.col("verdict") != "REFUSAL"
    supported = F.col("verdict") == "SUPPORTED"
    overlap = F.col("overlap")
    hits_gold = F.arrays_overlap("gold", "cited")
    answer = F.lower(F.trim(F.coalesce("counterfactual_answer", F.lit(""))))
    tally = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    told = claims.join(facts, ["arm", "query_id"]).withColumn("overlap", T.word_share(T.claim_words(F.col("claim_text")), F.col("asked")))
    per_query = told.groupBy("arm", "query_id").agg(
        tally(graded).alias("graded"),
        tally(supported).alias("supported"),
        tally(F.col("verdict") == "UNSUPPORTED").alias("unsupported"),
        tally(graded & F.col("matched_chunk_id").isNotNull()).alias("attributed"),
        tally(graded & (F.col("node_scope") == "within_node")).alias("within"),
        tally(graded & (F.col("node_scope") == "cross_node") & ~F.col("span_type").isin(*EXTRACTIVE)).alias("violations"),
        tally(supported & (overlap == 0) & ~hits_gold).alias("irrelevant"),
        F.max(graded & (hits_gold | (overlap >= RELEVANCE_SHARE))).alias("relevant"),
        F.max(supported & (answer != "") & F.contains(F.lower("claim_text"), answer)).alias("followed"),
        F.array_distinct(F.flatten(F.collect_set(F.when(graded, F.col("cited"))))).alias("cited_all"),
        F.array_distinct(F.flatten(F.collect_set(F.when(supported, F.col("cited"))))).alias("cited_supported"),
    )
    rows = results.join(per_query, ["arm", "query_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.array().cast("array<string>")
    cited, cited_ok = F.coalesce("cited_all", none), F.coalesce("cited_supported", none)
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(whole)))
    satisfied = F.size(F.filter("pairs", lambda p: F.size(F.array_except(p, cited)) == 0))
    return rows.select(
        "arm", "query_id", "eval_layer", "expectation", "refused",
        *[zero(c).alias(c) for c in ("graded", "supported", "unsupported", "attributed", "within", "violations", "irrelevant")],
        F.coalesce("followed", F.lit(False)).alias("followed"),
        F.when(F.col("expectation") == "out_of_scope", F.col("refused"))
        .otherwise(~F.col("refused") & F.coalesce("relevant", F.lit(False))).alias("passes"),
        share(F.col("retrieved"), F.col("gold")).alias("recall"),
        share(cited_ok, F.col("gold")).alias("coverage"),
        share(cited, F.col("retrieved")).alias("quotation"),
        F.when(F.col("eval_tag").isin(*DIVERGENCE_TAGS) & (F.size("pairs") > 0), satisfied / F.size("pairs")).alias("fidelity"),
    )


def run_metrics(scores: DataFrame) -> DataFrame:
    """All run metrics per arm and per arm and layer (layer NULL = whole arm).

    Ratios over an empty pool are NULL, never 0.
    """
    total = lambda c: F.sum(F.col(c))
    count_if = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    mean = lambda c: F.round(F.avg(c), 6)
    out_of_scope = F.col("expectation") == "out_of_scope"
    counterfactual = F.col("expectation") == "counterfactual"
    tp, fp = count_if(out_of_scope & F.col("refused")), count_if(~out_of_scope & F.col("refused"))
    fn, tn = count_if(out_of_scope & ~F.col("refused")), count_if(~out_of_scope & ~F.col("refused"))
    fabrication = F.try_divide(total("unsupported"), total("supported") + total("unsupported"))
    return scores.groupingSets(
        [[F.col("arm")], [F.col("arm"), F.col("eval_layer")]], F.col("arm"), F.col("eval_layer")
    ).agg(
        F.count(F.lit(1)).alias("n_queries"),
        total("graded").alias("n_claims"),
        F.round(fabrication, 6).alias("fabrication_rate"),
        F.round(1 - fabrication, 6).alias("grounded_precision"),
        ratio(total("attributed"), total("graded")).alias("attribution_coverage"),
        ratio(count_if(counterfactual & F.col("followed")), count_if(counterfactual)).alias("counterfactual_adherence"),
        ratio(tp, tp + fp).alias("failure_precision"),
        ratio(tp, tp + fn).alias("failure_recall"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        ratio(total("within"), total("graded")).alias("cross_node_within_ratio"),
        total("violations").alias("cross_node_violations"),
        ratio(count_if(F.col("passes")), F.count(F.lit(1))).alias("query_relevance_rate"),
        mean("recall").alias("retrieval_recall"),
        mean("coverage").alias("gold_chunk_coverage"),
        ratio(total("irrelevant"), total("supported")).alias("supported_irrelevance_rate"),
        mean("quotation").alias("chunk_quotation_rate"),
        mean("fidelity").alias("divergence_fidelity"),
    )


def failing_queries(scores: DataFrame) -> DataFrame:
    return scores.where(~F.col("passes")).select("arm", "query_id")
