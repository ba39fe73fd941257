"""Path-template trees: judge URLs by rules and by labelled purity of templates.

Native columns only.  Paths are first written in shape form, so that most of
what follows runs on one row per (host, shape) instead of one per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import lower_ascii

#: (verdict, host + path) of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
WILD = "*"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """A segment with its variable parts generalised: long hexadecimal tokens
    and runs of digits become wildcards, words and file endings stay."""
    hexed = F.regexp_replace(segment, r"(?i)\b(?=[0-9a-f]*\d)[0-9a-f]{8,}(-[0-9a-f]{4,})*\b", WILD)
    return F.regexp_replace(hexed, r"\d+", WILD)


def domains(host: Column) -> Column:
    """The domains a host lies in, widest first and its own name last, without user and port; none for an address."""
    name = F.regexp_replace(F.regexp_replace(host, r"^[\s\S]*@", ""), r":\d*$", "")
    parts = F.filter(F.split(name, r"\."), lambda s: s != "")
    tails = F.transform(parts, lambda s, i: F.array_join(F.slice(parts, F.size(parts) - i, i + 1), "."))
    return F.when(name.rlike(r"^\d+(\.\d+){3}$|^\["), F.array().cast("array<string>")).otherwise(tails)


def literal_of(branch: Column) -> Column:
    """Index of the last segment without a wildcard; the size of the branch if there is none."""
    return F.size(branch) - F.array_position(
        F.transform(F.reverse(branch), lambda s: ~F.contains(s, F.lit(WILD))), F.lit(True)
    )


def merged_of(branch: Column) -> Column:
    """The branch with its last literal made a wildcard: what siblings share."""
    literal = literal_of(branch)
    return F.when(
        F.exists(branch, lambda s: ~F.contains(s, F.lit(WILD))),
        F.transform(branch, lambda s, i: F.when(i == literal, F.lit(WILD)).otherwise(s)),
    ).otherwise(branch)


def nodes(host: Column, branch: Column) -> Column:
    """(kind, level, at, path) of what a branch lies in, widest first: its domains (0), the host (1), every prefix
    of the path with the branch itself (2); then its siblings (3)."""
    node = lambda kind, level, at, path: F.struct(
        F.lit(kind).alias("kind"), level.alias("level"), at.alias("at"), path.cast("array<string>").alias("path"))
    names = domains(host)
    own = F.size(names)
    return F.concat(
        F.transform(names, lambda d, i: node(0, i, d, F.array())),
        F.array(node(1, own, host, F.array())),
        F.transform(branch, lambda s, i: node(2, own + i + 1, host, F.slice(branch, F.lit(1), i + 1))),
        F.array(node(3, own + F.size(branch) + 1, host, merged_of(branch))),
    )


def evidence(branches: DataFrame, totals: DataFrame) -> DataFrame:
    """(host, template, bad, labelled, above) for the labels (host, branch, bad, good) and the templates' own totals.

    ``above`` lists the (bad, seen) labels of what a template lies in, widest first
    and its siblings last.  A label stands in the narrowest of these only, and never
    in one as well as in the template's own labels, so that no label counts twice.
    """
    sums = (
        branches.where(F.col("bad") + F.col("good") > 0)
        .select("bad", "good", F.explode(nodes(F.col("host"), F.col("branch"))).alias("node"))
        .groupBy(F.col("node.kind").alias("k"), F.col("node.at").alias("a"), F.col("node.path").alias("p"))
        .agg(F.sum("bad").alias("in_bad"), F.sum(F.col("bad") + F.col("good")).alias("in_seen"))
    )
    chain = (
        totals.select("host", "template", "bad", "labelled", F.explode(nodes(F.col("host"), F.col("template"))).alias("node"))
        .join(sums, (F.col("node.kind") == F.col("k")) & (F.col("node.at") == F.col("a")) & (F.col("node.path") == F.col("p")), "left")
        .groupBy("host", "template")
        .agg(F.first("bad").alias("bad"), F.first("labelled").alias("labelled"), F.sort_array(F.collect_list(F.struct(
            F.col("node.level").alias("level"),
            F.greatest(F.coalesce("in_bad", F.lit(0)) - F.col("bad"), F.lit(0)).alias("bad"),
            F.greatest(F.coalesce("in_seen", F.lit(0)) - F.col("labelled"), F.lit(0)).alias("seen"),
        ))).alias("chain"))
    )
    last = F.size("chain") - 1  # the siblings; they lie in the path above the last literal
    over = last - 1 - F.size("template") + literal_of(F.col("template"))
    below = lambda i, part: F.when(i >= last - 1, F.lit(0)).otherwise(F.get("chain", i + 1)[part]) + F.when(
        i == over, F.get("chain", last)[part]).otherwise(F.lit(0))
    has_literal = F.exists("template", lambda s: ~F.contains(s, F.lit(WILD)))
    within = lambda x, i, part: F.when(i < last, F.greatest(x[part] - below(i, part), F.lit(0))).when(
        has_literal, x[part]).otherwise(F.lit(0))
    return chain.select("host", "template", "bad", "labelled", F.transform("chain", lambda x, i: F.struct(
        within(x, i, "bad").alias("bad"), within(x, i, "seen").alias("seen"))).alias("above"))


def smoothed(overall: float, weight: float) -> Column:
    """Purity of a template: the overall bad share, corrected by the labels of every step of ``above``, then by its own."""
    step = lambda bad, seen, prior: (bad + weight * prior) / (seen + weight)
    prior = F.aggregate("above", F.lit(float(overall)), lambda p, x: step(x["bad"], x["seen"], p))
    return step(F.col("bad"), F.col("labelled"), prior)


def templates(
    shapes: DataFrame, fan_out: int = 16, per_child: float = 4.0, z: float = 1.96, least: int = 5
) -> DataFrame:
    """(host, shaped, template, bad, labelled, above) for rows (host, shaped, n, bad, good).

    A tree node whose children are many (``fan_out``) and seldom seen twice
    (fewer than ``per_child`` pages each) makes its next segment a wildcard.
    Then branches that differ in their last literal only are merged where their
    labelled rate lies within ``z`` standard errors of the pooled rate; a branch
    with fewer than ``least`` labels gives no evidence and stays as it is.
    """
    steps = shapes.select(
        "host", "shaped", "n", F.posexplode("shaped").alias("level", "segment")
    ).withColumn("above", F.slice("shaped", F.lit(1), F.col("level")))
    fan = (
        steps.groupBy("host", "above")
        .agg(F.approx_count_distinct("segment").alias("kinds"), F.sum("n").alias("pages"))
        .where((F.col("kinds") >= fan_out) & (F.col("pages") < per_child * F.col("kinds")))
        .select(F.col("host").alias("h"), F.col("above").alias("a"), F.lit(True).alias("wild"))
    )
    general = (
        steps.join(fan, (F.col("host") == F.col("h")) & (F.col("above") == F.col("a")), "left")
        .groupBy("host", "shaped")
        .agg(F.sort_array(F.collect_list(F.struct(
            "level", F.when(F.col("wild"), WILD).otherwise(F.col("segment")).alias("segment")
        ))).alias("levels"))
        .select(F.col("host").alias("h"), F.col("shaped").alias("s"), F.col("levels.segment").alias("general"))
    )
    tree = shapes.join(
        general, (F.col("host") == F.col("h")) & (F.col("shaped") == F.col("s")), "left"
    ).select("host", "shaped", "bad", "good", F.coalesce("general", F.array().cast("array<string>")).alias("branch"))
    branches = durable(tree).groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    branches = durable(branches.withColumn("merged", merged_of(F.col("branch"))))
    pooled = branches.groupBy(F.col("host").alias("h"), F.col("merged").alias("m")).agg(
        F.sum("bad").alias("pool_bad"), F.sum(F.col("bad") + F.col("good")).alias("pool"), F.count("*").alias("siblings")
    )
    seen = F.col("bad") + F.col("good")
    rate = (F.col("pool_bad") + 0.5) / (F.col("pool") + 1.0)
    alike = (F.col("siblings") > 1) & (seen >= least) & (
        F.abs(F.col("bad") / seen - rate) <= z * F.sqrt(rate * (1 - rate) / seen) + 0.5 / seen
    )
    chosen = branches.join(
        pooled, (F.col("host") == F.col("h")) & (F.col("merged") == F.col("m"))
    ).select("host", "branch", "bad", "good",
             F.when(alike, F.col("merged")).otherwise(F.col("branch")).alias("template"))
    totals = chosen.groupBy("host", "template").agg(
        F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labelled")
    )
    names = chosen.select(F.col("host").alias("h"), F.col("branch").alias("b"), F.col("template").alias("t"))
    return (
        tree.select("host", "shaped", "branch")
        .join(names, (F.col("host") == F.col("h")) & (F.col("branch") == F.col("b")))
        .select(F.col("host"), "shaped", F.col("t").alias("template"))
        .join(evidence(branches, totals), ["host", "template"])
    )


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, weight: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page.

    ``labels`` (page_id, bad) may label pages; without it the rules' verdicts
    are the labels.  A template's purity is ``(bad + weight * p) / (labelled +
    weight)``; above one half it is rejected.  p is found alike from the labels of
    its siblings, theirs from the path prefix above, and so on over the host and the
    domains it lies in to the bad share of all labels, so a template without labels
    follows what lies nearest.  Null urls and urls without :// have an empty host
    and path, fit no rule and have only what else is under the empty host and that
    last share.  Rows may repeat; each is judged.
    """
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != "").alias("segments"),
    )
    rows = rows.select(
        "page_id", "host", "path", F.transform("segments", shape).alias("shaped"),
        rule_of(F.col("host"), F.col("path"), rules).alias("fit"),
    )
    if labels is None:
        rows = rows.withColumn("bad", (F.col("fit.verdict") == "block").cast("int"))
    else:
        marks = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
        rows = rows.join(marks, "page_id", "left")
    rows = durable(rows)
    shapes = durable(rows.groupBy("host", "shaped").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("good"),
    ))
    bad, good = shapes.agg(F.sum("bad"), F.sum("good")).first()
    overall = (bad or 0) / ((bad or 0) + (good or 0)) if (bad or 0) + (good or 0) else 0.0
    found = templates(shapes).select(
        F.col("host").alias("h"), F.col("shaped").alias("s"), "template", smoothed(overall, weight).alias("purity")
    )
    return rows.join(
        found, (F.col("host") == F.col("h")) & (F.col("shaped") == F.col("s")), "left"
    ).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "purity",
    )
