"""Consolidating pairwise matches into groups: alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.skew import lookup_join
from lorekeep.session import cut


def _minima(edges: DataFrame, of: str, other: str) -> DataFrame:
    """Of each node in ``of``: the least of itself and its neighbours in ``other``, and how many rows it has."""
    return edges.groupBy(of).agg(F.min(other).alias("m"), F.count("*").alias("degree")).withColumn("m", F.least(of, "m"))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connects every larger neighbour of a node to the node's least neighbour. ``edges`` is ``(u > v)``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = lookup_join(both, _minima(both, "u", "v"), ["u"], "degree", 2 * total)
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connects a node and its smaller neighbours to the least of them. ``edges`` is ``(u > v)``."""
    least = _minima(edges, "u", "v")
    joined = lookup_join(edges, least, ["u"], "degree", total)
    moved = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, root)`` of every record in a group of two or more; ``root`` is the least id of its group.

    ``links`` has one row per match in the columns ``a`` and ``b``; other columns are ignored. Order,
    repetition and self matches don't matter; a row with a null end links nothing, and a record that
    only matches itself is in no group. Groups chain over any number of links. No group is collected:
    a round is two aggregates and joins over the edges, hot nodes are joined apart, and each round's
    edges are written to the checkpoint folder. An empty input gives no rows.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(small_star(cut(large_star(edges, state[0])), state[0]))
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
