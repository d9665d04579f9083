"""Connected components by contraction, every round a few joins over the edges that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorgrid.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (src, dst); component is the smallest node.

    Each round hangs every node under its smallest neighbour if that is smaller, renames the ends of
    the edges and drops loops. Only nodes smaller than all neighbours keep their name, so at least
    half of the nodes that still have edges vanish per round. The edge under which a node was hung
    is renamed too and keeps the parts connected. A smallest node never changes its name.
    """
    left = settle(edges.where("src <> dst").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(),
        "edges")
    names = None
    while left.take(1):
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        under = settle(
            both.groupBy("src").agg(F.min("dst").alias("low")).select(
                F.col("src").alias("node"), F.least("src", "low").alias("up")), "parents")
        if names is None:
            names = under.select("node", F.col("up").alias("component"))
        else:
            named = under.select(F.col("node").alias("component"), "up")
            names = settle(names.join(named, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")), "names")
        a = under.select(F.col("node").alias("src"), F.col("up").alias("a"))
        b = under.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        left = settle(
            left.join(a, "src").join(b, "dst").where("a <> b").select(
                F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(),
            "edges")
    if names is None:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return names
