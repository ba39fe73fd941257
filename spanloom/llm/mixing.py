"""Entropy balancing: a mix of sources with given token totals.

The mix gives document i a rate r_i, its expected number of copies.  Among all
rates that meet ``sum(size_i * r_i) = target_s`` in every source s, the one
closest in relative entropy (measured per token) to the prior rates q_i is an
exponential tilt, ``r_i = min(cap, q_i * exp(lambda_s))``.  The multipliers
maximise a concave dual that falls apart by source; Newton steps on it are
aggregates over (source, prior) cells, so a step moves one row per cell however
many documents a source has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import words

WEIGHTS = (3, 1, 2)
CELL_WORDS = 2_000_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words of the whole text."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size, target), one row per source, null a source of its own.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``budget`` times all words.  A target stops at ``cap`` times its source's
    size and the excess is shared by weight among the others, until no target
    is above.  Each pass is one aggregate of two sums.
    """
    spark = sizes.sparkSession
    ordered = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .orderBy(F.col("source").asc_nulls_last())
    )
    rows = ordered.rdd.zipWithIndex().map(lambda p: (p[0][0], p[0][1], float(weights[p[1] % len(weights)])))
    sources = durable(spark.createDataFrame(rows, "source string, source_size long, weight double"))
    most = F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > most
        held, free = sources.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        reached = (budget * total - (held or 0.0)) / free if free else level
        if reached is None or reached == level:
            break
        level = reached
    return sources.select("source", "source_size", F.least(most, F.col("weight") * (level or 0.0)).alias("target"))


def multipliers(
    cells: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-12, steps: int = 100
) -> DataFrame:
    """(source, lam): safeguarded Newton iterations on the dual of the token
    constraints, all sources at once.

    ``cells`` holds (source, prior, tokens).  The start meets the constraints as
    long as no rate is at the cap; from there a step that would leave the
    interval known to hold the solution halves it instead.  ``steps`` guards
    against targets that cannot be met (above the cap times the source's size).
    """
    sums = cells.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("prior")).alias("mass"), F.min("prior").alias("least")
    ).withColumnRenamed("source", "s")
    ends = targets.join(sums, F.col("source").eqNullSafe(F.col("s")))
    start = F.when((F.col("mass") > 0) & (F.col("target") > 0), F.log(F.col("target") / F.col("mass"))).otherwise(0.0)
    state = durable(ends.select(
        "source", "target", start.alias("lam"), start.alias("low"),
        F.greatest(start, F.log(F.lit(cap) / F.col("least"))).alias("high"),
    ))
    for _ in range(steps):
        tilted = F.col("prior") * F.exp("lam")
        sums = (
            cells.withColumnRenamed("source", "s")
            .join(state, F.col("s").eqNullSafe(F.col("source")))
            .groupBy("source", "target", "lam", "low", "high")
            .agg(
                F.sum(F.col("tokens") * F.least(F.lit(cap), tilted)).alias("taken"),
                F.sum(F.when(tilted < cap, F.col("tokens") * tilted).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("target") - F.col("taken")
        met = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        low = F.when(gap > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + gap / F.nullif(F.col("slope"), F.lit(0.0))
        move = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = durable(sums.select(
            "source", "target", F.when(met, F.col("lam")).otherwise(move).alias("lam"),
            low.alias("low"), high.alias("high"), met.alias("met"),
        ))
        if state.where(~F.col("met")).isEmpty():
            break
        state = state.drop("met")
    return state.select("source", "lam")


def _rounded(cell: pd.DataFrame) -> pd.DataFrame:
    """Whole copies, largest document first; what rounding owes or is owed is
    carried on, so that a cell ends within about its smallest document."""
    cell = cell.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    size, rate = cell["size"].to_numpy(), cell["rate"].to_numpy()
    low, high = np.floor(rate + 1e-9), np.ceil(rate - 1e-9)
    copies, owed = np.floor(rate + 0.5), 0.0
    for i in np.flatnonzero(size > 0):
        owed += size[i] * rate[i]
        copies[i] = min(max(np.rint(owed / size[i]), low[i]), high[i])
        owed -= copies[i] * size[i]
    return cell.drop(columns=["cell", "rate"]).assign(copies=copies.astype("int64"))


def mixed(
    sizes: DataFrame, targets: DataFrame, cap: float = 2.0, cell_words: int = CELL_WORDS
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (= copies * size).

    ``sizes`` holds doc_id, source, size and, if wished, prior (a positive rate
    per document, 1 by default).  Rounding works in cells of about ``cell_words``
    words of one source, dealt by a hash of doc_id, so a source of any size is
    spread over as many tasks as it has cells, and reruns agree.  Rows that
    repeat are rounded one by one; null doc_ids are a document like any other;
    documents without words get their rate rounded to the nearest whole.
    """
    if "prior" not in sizes.columns:
        sizes = sizes.withColumn("prior", F.lit(1.0))
    cells = sizes.groupBy("source", "prior").agg(F.sum("size").alias("tokens"))
    lam = multipliers(durable(cells), targets, cap).withColumnRenamed("source", "l")
    per_source = targets.join(lam, F.col("source").eqNullSafe(F.col("l"))).drop("l").withColumnRenamed("source", "s")
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(cell_words)))).cast("long")
    rated = sizes.join(per_source, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target",
        F.least(F.lit(cap), F.col("prior") * F.exp("lam")).alias("rate"),
        F.pmod(F.xxhash64("doc_id"), parts).alias("cell"),
    )
    kind = dict(sizes.dtypes)["doc_id"]
    return (
        rated.groupBy("source", "cell")
        .applyInPandas(
            _rounded, f"doc_id {kind}, source string, size long, source_size long, target double, copies long"
        )
        .select("doc_id", "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The whole mix of ``docs`` (doc_id, text, source); see :func:`mixed`.

    The texts are read once; what follows works on checkpointed narrow rows.
    """
    sizes = durable(sized(docs))
    return mixed(sizes, source_targets(sizes, weights, budget, cap), cap)
