"""Connected components over an edge table, by contraction rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeloom.session import durable


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round gives every node the smallest node around it, doubles these pointers until they end at
    local minima, and contracts the edges onto those, so that the nodes at least halve; hubs cost one
    partially aggregated minimum. Loops and repeated edges are allowed, nulls are dropped, no edges give no rows. State is
    cut with reliable checkpoints, nothing is collected.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null")
    e = durable(e.distinct())
    steps: list[DataFrame] = []
    current = e
    for _ in range(most_rounds):
        live = current.where("a <> b")
        if live.isEmpty():
            break
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("to"))
        up = durable(up)
        # Pointers lead to ever smaller nodes, so that doubling them ends at local minima.
        while True:
            further = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            moved = durable(up.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("to"), (F.coalesce("further", "to") != F.col("to")).alias("moved")))
            up = moved.select("node", "to")
            if moved.where("moved").isEmpty():
                break
        steps.append(up)
        left = live.join(up.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        current = durable(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("component"))
    follow = lambda acc, step: acc.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return reduce(follow, steps, nodes)
