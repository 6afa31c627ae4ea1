"""Connected components by repeated contraction, as joins and sums over written tables.

Each round every node points to its smallest neighbour if that is smaller than itself, pointers are followed once
more, and edges are rewritten between the nodes pointed to; edges inside one node vanish. Every component's smallest
node never moves, so it is the label in the end. Nothing but the number of remaining edges reaches the driver. A hot
node is a hot key of joins (split by the adaptive skew join) and of a minimum (summed before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node): one row for each node that has an edge; ids are longs, null ends are ignored."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    e = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = None
    while not e.isEmpty():
        near = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        near = written(near, "pointers")
        over = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = written(near.join(over, "up").select("node", "top"), "pointers")
        if found is None:
            found = up.select("node", F.col("top").alias("component"))
        else:
            moved = up.select(F.col("node").alias("component"), "top")
            found = written(found.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
        left = up.select(F.col("node").alias("a"), F.col("top").alias("ta"))
        right = up.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        e = written(e.join(left, "a").join(right, "b").where("ta != tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")) if found is None else found
