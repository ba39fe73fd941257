"""Connected components of an edge list."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Edges of a task between two exchanges.
EDGES = 50_000


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Links every neighbour of a node to the least node of its neighbourhood:
    larger neighbours only (``both``), or the smaller ones and the node itself."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = seen.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = seen.join(least, seen["a"] == least["n"])
    moved = linked.where((F.col("b") > F.col("a")) if both else (F.col("b") != F.col("m"))).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    if both:
        return moved.where("a <> b")  # what repeats goes with the small star
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b).

    Alternates large and small stars until nothing moves, O(log**2 n) rounds and
    few on shallow graphs.  Minima are combined before they are shuffled; the
    joins that hand them out have the unique side per node and can be split
    where a node has very many neighbours.  Each round is checkpointed.

    Every task writes files of its own, however few its edges, and a round has several
    exchanges; so what goes into one is held by as many tasks as the edges call for.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = durable(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    tasks = max(1, ceil(now.count() / EDGES))     # a round never adds edges
    now = now.coalesce(tasks)
    mark = None
    while True:
        # a stands for the larger end, so the small star's neighbours are the smaller ones
        large = _star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = durable(_star(large.coalesce(tasks), False).coalesce(tasks))
        # a forest of stars maps onto itself
        reached = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if reached == mark:
            break
        mark = reached
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
