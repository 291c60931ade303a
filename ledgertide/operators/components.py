"""Connected components of an edge table, by contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.working import stored

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node that it reaches.

    edges has columns a and b. In each round every node points to the smallest of itself and its neighbours, pointers are
    followed JUMPS times over, and edges are redrawn between what their ends point to. A node that is larger than a
    neighbour leaves in each round, so rounds end; mostly far more do (a hub of greatest number, with only smaller ones around it,
    takes one round more). Each round is stored, so no lineage grows; the driver only sees whether edges are left. Hubs meet
    only in grouped minima and in joins whose skewed side Spark splits. Loops and repeated edges do no harm; an empty table
    gives none.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")), "parents")
        for _ in range(JUMPS):
            to = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to"))
        to = stored(to, "parents")
        rounds.append(to)
        at = lambda side, df: df.join(to.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}")), side)  # noqa: E731, B023
        redrawn = at("b", at("a", edges)).where("to_a <> to_b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b"))
        edges = stored(redrawn.distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].select("node", F.col("to").alias("component"))
    for to in rounds[1:]:
        nxt = to.select(F.col("node").alias("component"), "to")
        found = found.join(nxt, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return found
