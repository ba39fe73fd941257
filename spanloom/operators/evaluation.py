"""Scoring proposed edges against gold: precision, recall, controls, judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import doc_pair


def unordered(src: Column, dst: Column) -> Column:
    return F.struct(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))


def _count_if(cond: Column, n: Column | None = None) -> Column:
    hit = F.coalesce(cond, F.lit(False)).cast("bigint")
    return F.sum(hit if n is None else hit * n)


def _weight(cases: DataFrame) -> Column:
    return F.col("n") if "n" in cases.columns else F.lit(1).cast("bigint")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F1, NULL where undefined."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"),
    ]


def gold_scores(proposals: DataFrame, gold: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Contradiction P/R/F1 overall (register NULL) and by register, plus the
    share of corroborating pairs not typed as contradictions.  Pairs outside the
    gold set are ignored; a gold pair nobody proposed counts as unrelated.

    answered: register, relation and got (the proposed relation) of gold pairs that
    need not be looked up among the proposals.
    """
    got = proposals.groupBy(unordered(F.col("src"), F.col("dst")).alias("pair")).agg(
        F.max_by("relation", F.col("seq")).alias("got")
    )
    rows = gold.withColumn("pair", unordered(F.col("src"), F.col("dst"))).join(got, "pair", "left").select("register", "relation", "got")
    if answered is not None:
        rows = rows.unionByName(answered.select("register", "relation", "got"))
    is_gold, is_got = F.col("relation") == "contradicts", F.coalesce(F.col("got") == "contradicts", F.lit(False))
    agrees = F.col("relation") == "corroborates"
    counted = rows.groupingSets([[], [F.col("register")]], F.col("register")).agg(
        _count_if(is_gold & is_got).alias("tp"),
        _count_if(~is_gold & is_got).alias("fp"),
        _count_if(is_gold & ~is_got).alias("fn"),
        _count_if(agrees).alias("controls"),
        _count_if(agrees & ~is_got).alias("controls_passed"),
    )
    return counted.select(
        "register", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")),
        F.round(F.try_divide(F.col("controls_passed"), F.col("controls")), 6).alias("control_pass_rate"),
    )


def doc_level_scores(admitted: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp and missed counts after both sides collapse to document pairs."""
    collapse = lambda rows, flag: rows.select(
        doc_pair(F.col("src"), F.col("dst")).alias("docs"), F.lit(True).alias(flag)
    ).distinct()
    joined = collapse(admitted, "found").join(collapse(gold, "wanted"), "docs", "full_outer")
    return joined.agg(
        _count_if(F.col("found") & F.col("wanted")).alias("tp"),
        _count_if(F.col("found") & F.col("wanted").isNull()).alias("fp"),
        _count_if(F.col("wanted") & F.col("found").isNull()).alias("missed"),
    )


def split_false_positives(admitted: DataFrame, gold: DataFrame, curated: DataFrame) -> DataFrame:
    """Admitted pairs that are not gold, marked anchor_discovery when their
    document pair holds a curated edge, else false_positive."""
    keyed = lambda rows: rows.select(unordered(F.col("src"), F.col("dst")).alias("pair")).distinct()
    extra = keyed(admitted).join(keyed(gold), "pair", "left_anti")
    docs = curated.select(doc_pair(F.col("src"), F.col("dst")).alias("docs"), F.lit(True).alias("known")).distinct()
    return (
        extra.withColumn("docs", doc_pair(F.col("pair.a"), F.col("pair.b")))
        .join(docs, "docs", "left")
        .select(
            F.col("pair.a").alias("src"), F.col("pair.b").alias("dst"),
            F.when(F.col("known"), "anchor_discovery").otherwise("false_positive").alias("kind"),
        )
    )


def typed_scores(rows: DataFrame) -> DataFrame:
    """tp/fp/fn and P/R of (gold, typed) rows; NaN, not NULL, when nothing counts."""
    counted = rows.agg(
        _count_if(F.col("gold") & F.col("typed")).alias("tp"),
        _count_if(~F.col("gold") & F.col("typed")).alias("fp"),
        _count_if(F.col("gold") & ~F.col("typed")).alias("fn"),
    )
    nan = F.lit(float("nan"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), nan)
    return counted.select("tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def judge_scores(judged: DataFrame) -> DataFrame:
    """Per block of judged pairs (block, label, reverse_label): totals, scorable
    rows, hits and direction flips.  A gold block hits on DIVERGENT, a control
    block on anything else; a row with NULL label was skipped but still counted."""
    divergent = F.col("label") == "DIVERGENT"
    hit = F.when(F.col("block") == "issue_frame", divergent).otherwise(~divergent)
    return judged.groupBy("block").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("label").alias("scorable"),
        _count_if(hit).alias("hits"),
        _count_if(F.col("label") != F.col("reverse_label")).alias("flips"),
        F.round(F.try_divide(_count_if(hit), F.count("label")), 6).alias("rate"),
    )


def noise_cases(scores: DataFrame, edges: DataFrame, chunks: DataFrame, floor: float) -> DataFrame:
    """A case per query and edge whose source the query matches: noise_class, should_force,
    and forced where both ends reach ``floor``.

    scores: query_id, chunk_id, relevance.  A chunk's queries travel as one list, so the
    edges meet chunks and not chunks times queries.
    """
    hot = F.col("relevance") >= floor
    lists = scores.groupBy("chunk_id").agg(
        F.collect_list("query_id").alias("listed"), F.collect_list(F.when(hot, F.col("query_id"))).alias("hot"),
        _count_if(F.col("query_id").isNull()).alias("unnamed"),
    )
    side = lambda key: chunks.select(F.col("chunk_id").alias(key), F.col("outlet").alias(f"{key}_outlet"), F.col("eval_layer").alias(f"{key}_layer"))
    ends = edges.join(side("src"), "src").join(side("dst"), "dst")
    rows = ends.join(lists.withColumnRenamed("chunk_id", "src"), "src").join(
        lists.select(F.col("chunk_id").alias("dst"), F.col("hot").alias("dst_hot")), "dst", "left"
    )
    same = (F.col("src_layer") == F.col("dst_layer")) & (F.col("src_outlet") == F.col("dst_outlet"))
    forced = F.size(F.array_intersect("hot", F.coalesce("dst_hot", F.array().cast(dict(lists.dtypes)["hot"]))))
    counted = rows.select(
        F.when(F.col("src_layer") != F.col("dst_layer"), "C").when(F.col("src_outlet") == F.col("dst_outlet"), "E").otherwise("A").alias("noise_class"),
        same.alias("should_force"), forced.cast("bigint").alias("forced"), (F.size("listed") + F.col("unnamed")).alias("listed"),
    )
    case = lambda forced, n: F.struct(F.lit(forced).alias("forced"), n.cast("bigint").alias("n"))
    cases = F.array(case(True, F.col("forced")), case(False, F.col("listed") - F.col("forced")))
    return counted.select("noise_class", "should_force", F.inline(cases)).where("n > 0")


def stress_scores(cases: DataFrame) -> DataFrame:
    """Edge-noise outcome by class: rows, forced divergences, right decisions.

    cases: noise_class, forced, should_force, and ``n`` where a row stands for several."""
    n = _weight(cases)
    return cases.groupBy("noise_class").agg(
        F.sum(n).alias("n"),
        _count_if(F.col("forced"), n).alias("forced_divergent"),
        _count_if(F.col("forced") == F.col("should_force"), n).alias("correct"),
    )


def stress_rates(cases: DataFrame) -> DataFrame:
    noise, n = ~F.col("should_force"), _weight(cases)
    return cases.agg(
        F.round(F.try_divide(_count_if(noise & ~F.col("forced"), n), _count_if(noise, n)), 6).alias("noise_rejection_rate"),
        F.round(F.try_divide(_count_if(~noise & F.col("forced"), n), _count_if(~noise, n)), 6).alias("true_positive_retention"),
    )
