"""Connected components of a table of links, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    In a round every node goes to the smallest of itself and its neighbours, and on to where that one goes; links are
    then drawn between the nodes that remain. Each round at least merges every node that has a smaller neighbour, so a
    few rounds do. Links with a null end are left out; an empty table has no components.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    lone = links.where("a = b").select(F.col("a").alias("node")).distinct()
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        near = materialize(near, "hooks")
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = materialize(near.join(onward, "to").select("node", F.col("then").alias("to")), "hooks")
        steps.append(step)
        first = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        second = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = materialize(
            edges.join(first, "a").join(second, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links",
        )
    if not steps:
        return lone.select("node", F.col("node").alias("component"))
    found = steps[-1].withColumnRenamed("to", "component")
    for step in reversed(steps[:-1]):
        after = found.select(F.col("node").alias("to"), "component")
        found = step.join(after, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return found.unionByName(lone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
