"""Quality rules: text statistics and a learned decision list, as columns.

The statistics are higher-order functions over each row, so a text is never
split over rows and nothing is shuffled.  The list is learned by sequential
covering from binned counts of the labelled rows; the driver sees one small
table (feature x bin x class) per step, however many rows are labelled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import let, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _times(text: Column, characters: str) -> Column:
    """Occurrences of any of ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _window_hashes(w: Column, width: int) -> Column:
    return F.when(
        F.size(w) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, width: int) -> Column:
    """Positions covered by windows that occur twice or more, in n log n."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(placed, lambda s: F.filter(s, lambda e, k: (
        F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
    )))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    steps = let(starts, lambda s: F.transform(
        s, lambda p, k: F.coalesce(F.least(F.lit(width), F.get(s, k + 1) - p), F.lit(width))
    ))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def repeat_words(w: Column, width: int = 5) -> Column:
    """Words of ``w`` in windows found at least twice; most texts have none and
    are settled by comparing the number of windows with that of distinct ones."""
    return let(
        _window_hashes(w, width),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, width)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and version (a hash of the text) with the base statistics and those
    the learned list may use, one row per row of ``docs``.

    A null text has no words and no lines; all its counts are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    per_text = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        ),
    )
    per_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    ))
    return docs.select(
        "doc_id", F.xxhash64("text").alias("version"), per_text.alias("w"), per_line.alias("l"),
        _times(text, SYMBOLS).cast("long").alias("n_symbols"),
        _times(text, CAPITALS).cast("long").alias("n_capitals"),
        _times(text, "!?").cast("long").alias("n_marks"),
        _times(text, "0123456789").cast("long").alias("n_digits"),
    ).select(
        "doc_id", "version", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        "w.n_distinct", "l.n_lines", "n_capitals", "n_marks", "n_digits",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _per(count: str, whole: str) -> Column:
    return F.col(count) / F.greatest(F.col(whole), F.lit(1))




def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": _per("word_chars", "n_words"),
        "symbols": _per("n_symbols", "n_words"),
        "capitals": _per("n_capitals", "word_chars"),
        "marks": _per("n_marks", "n_words"),
        "digits": _per("n_digits", "word_chars"),
        "distinct": _per("n_distinct", "n_words"),
        "repeats": _per("n_repeat_words", "n_words"),
        "dup_lines": _per("n_dup_lines", "n_lines"),
        "line_words": _per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule, column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & column(c)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


class Learner:
    """Sequential covering over labelled rows (the feature columns and ``bad``).

    Thresholds are the ``bins``-quantiles of each feature.  Two thirds of the
    rows, by hash, grow a rule by information gain; the rest prune it and decide
    whether it is precise enough to keep.
    """

    def __init__(self, labelled: DataFrame, bins: int = 64, precision: float = 0.9, least: int = 5,
                 conditions: int = 3, rules: int = 8):
        self.names = list(features())
        self.precision, self.least, self.conditions, self.most = precision, least, conditions, rules
        levels = [i / bins for i in range(1, bins)]
        cuts = labelled.agg(*[F.percentile_approx(F.col(f), levels, 10_000).alias(f) for f in self.names]).first()
        self.cuts = {f: sorted(set(cuts[f] or ())) for f in self.names}
        rank = [self.rank(f).alias(f) for f in self.names]
        self.rows = durable(
            labelled.select(*rank, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"))
            .groupBy(*self.names, "bad", "prune").agg(F.count("*").alias("n"))
        )

    def rank(self, feature: str) -> Column:
        """The number of cuts below the feature's value."""
        cuts = F.array(*map(F.lit, self.cuts[feature])) if self.cuts[feature] else F.array().cast("array<double>")
        return F.size(F.filter(cuts, lambda c: c < F.col(feature)))

    def holds(self, condition: Condition) -> Column:
        at = self.cuts[condition.feature].index(condition.threshold)
        return F.col(condition.feature) > at if condition.above else F.col(condition.feature) <= at

    def covered(self, rules: list[Rule]) -> Column:
        out = F.lit(False)
        for r in rules:
            out = out | _all(r, self.holds)
        return out

    def counts(self, rows: DataFrame) -> dict[str, dict[int, list[int]]]:
        """(good, bad) per feature and bin."""
        pairs = F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in self.names
        ])).alias("at")
        out: dict = {f: {} for f in self.names}
        for f, b, bad, n in (
            rows.select(pairs, "bad", "n").groupBy("at.feature", "at.bin", "bad").agg(F.sum("n")).collect()
        ):  # at most features x bins x 2 rows
            out[f].setdefault(b, [0, 0])[bad] += n
        return out

    def best(self, rows: DataFrame) -> tuple[Condition | None, tuple[int, int], tuple[int, int]]:
        table = self.counts(rows)
        n0, p0 = (sum(v[k] for v in table[self.names[0]].values()) for k in (0, 1))
        top, choice, kept = 1e-9, None, (p0, n0)
        for f in self.names:
            n = p = 0
            for at, cut in enumerate(self.cuts[f]):
                good, bad = table[f].get(at, (0, 0))
                n, p = n + good, p + bad
                for above, (pc, nc) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    gain = _gain(pc, nc, p0, n0) if pc >= self.least and (pc, nc) != (p0, n0) else -math.inf
                    if gain > top:
                        top, choice, kept = gain, Condition(f, above, cut), (pc, nc)
        return choice, (p0, n0), kept

    def grown(self, rows: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < self.conditions:
            condition, (p0, n0), _ = self.best(rows.where(_all(rule, self.holds)))
            if not p0 or not n0 or condition is None:
                break
            rule += (condition,)
        return rule

    def pruned(self, rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
        """The shortest beginning of ``rule`` that is best on the prune rows."""
        cuts = range(1, len(rule) + 1)
        sums = rows.agg(*[
            F.coalesce(F.sum(F.when(_all(rule[:k], self.holds) & (F.col("bad") == b), F.col("n"))), F.lit(0))
            for k in cuts for b in (1, 0)
        ]).first()
        scored = [((sums[2 * k - 2] - sums[2 * k - 1]) / max(1, sums[2 * k - 2] + sums[2 * k - 1]), -k) for k in cuts]
        k = -max(scored)[1]
        return rule[:k], sums[2 * k - 2], sums[2 * k - 1]

    def learned(self) -> list[Rule]:
        rules: list[Rule] = []
        while len(rules) < self.most:
            left = self.rows.where(~self.covered(rules))
            rule = self.grown(left.where(~F.col("prune")))
            if not rule:
                break
            rule, p, n = self.pruned(rule, left.where("prune"))
            if p + n == 0 or p < self.precision * (p + n):
                break
            rules.append(rule)
        return rules


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that
    rejects the row (from 1), 0 if none does."""
    if not rules:
        return F.lit(0)
    first, *rest = rules
    out = F.when(_all(first, Condition.column), F.lit(1))
    for k, rule in enumerate(rest, 2):
        out = out.when(_all(rule, Condition.column), F.lit(k))
    return out.otherwise(F.lit(0))


def learn(stats: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """A decision list for quality = 0 from all rows of ``labels`` (doc_id,
    quality) whose quality is not null; without any, an empty list."""
    marks = labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"))
    labelled = stats.join(marks, "doc_id").select("doc_id", "bad", *[c.alias(f) for f, c in features().items()])
    labelled = durable(labelled)
    return [] if labelled.isEmpty() else Learner(labelled, **options).learned()


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, base_failed, rule (the deciding rule's number) and kept."""
    stats = durable(statistics(docs))
    rule = decision(learn(stats, labels, **options))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )
