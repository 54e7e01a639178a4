"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_spread
from ..session import durable


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the lowest of the node and its neighbours.

    ``edges`` have u > v, so the neighbours above a node are the u of its rows as v, and each edge is
    joined once, by its lower end.
    """
    low = _lowest(edges).select(F.col("u").alias("v"), "low")
    return edges.join(low, "v", "left").select("u", F.coalesce("low", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the lowest of these."""
    joined = edges.join(_lowest(edges), "u")
    ties = joined.select(F.explode(F.array(F.struct("u", "low"), F.struct(F.col("v").alias("u"), "low"))).alias("e"))
    return ties.select("e.u", F.col("e.low").alias("v")).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of each node of ``edges`` (u, v) but the smallest ones.

    Large-star and small-star steps alternate until nothing changes; each round is staged, so the
    lineage stays short. Every shuffle by node is that of a join followed by another shuffle, so adaptive
    execution splits the edges of a node that has too many. Self-loops, repeats and directions do not matter.
    """
    current = durable(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before, after = None, _state(current)
    while after != before:
        current = durable(_small_star(_large_star(current)))
        before, after = after, _state(current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def least_of_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``reached`` of each of ``nodes`` (node, least): the smallest ``least`` in its component.

    Nodes have numbers of their own, so different nodes may have the same ``least``. A component with a
    large share of all nodes is split.
    """
    members = durable(
        nodes.join(connected_components(edges), "node", "left").select(
            "node", "least", F.coalesce("component", "node").alias("component")
        )
    )
    several = durable(
        members.groupBy("component").agg(F.min("least").alias("reached"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    )
    joined = join_spread(
        members, several.select("component", "reached"), ["component"], several.select("component", "rows"), "node"
    )
    return joined.select("node", F.coalesce("reached", "least").alias("reached"))
