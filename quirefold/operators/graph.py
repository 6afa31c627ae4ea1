"""Graphs of references as tables: following chains of references, what is reachable, what nothing uses any more.

Edges are rows (keys, from, to). All loops write what they have got to the shared folder and see one number of it on
the driver. Chains are followed by pointer doubling, in as many rounds as the logarithm of the longest. What is
reachable is found in rounds, too: lines of nodes with one predecessor each are contracted first, so there are as many
rounds as nodes with several predecessors follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.stored import stored


def _on(keys: list[str], *pairs: tuple[str, str]) -> Column:
    """Equality of the keys (the right side's are named _<key>) and of column pairs."""
    both = F.lit(True)
    for k in keys:
        both = both & F.col(k).eqNullSafe(F.col(f"_{k}"))
    for a, b in pairs:
        both = both & (F.col(a) == F.col(b))
    return both


def _right(df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(n) for n, c in columns.items()])


def resolved(pointers: DataFrame, keys: list[str], node: str = "from", to: str = "to") -> DataFrame:
    """keys, node, last: where each node's chain of pointers ends; null for chains that never end (cycles).

    A node points to one other at most; pointers: keys, node, to.
    """
    now = stored(pointers.select(*keys, F.col(node).alias("node"), F.col(to).alias("last"), F.lit(True).alias("open")), "pointers")
    longest, rounds = now.count(), 0
    while (1 << rounds) <= 2 * longest and not now.where("open").isEmpty():
        ahead = _right(now, keys, _node="node", _last="last", _open="open")
        moved = now.join(ahead, _on(keys, ("last", "_node")), "left")
        now = stored(moved.select(*keys, "node", F.coalesce("_last", "last").alias("last"), F.coalesce(F.col("_open") & F.col("_last").isNotNull(), F.lit(False)).alias("open")), "pointers")
        rounds += 1
    return now.select(*keys, F.col("node").alias(node), F.when(~F.col("open"), F.col("last")).alias("last"))


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str], source: str = "from", target: str = "to") -> DataFrame:
    """keys, node: the roots and all that they lead to, directly or not. roots: keys, node.

    Each round takes in what the nodes found last lead to; before that, nodes with one predecessor are put under the
    first of their line, so that a long line is one step.
    """
    e = stored(edges.select(*keys, F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null and a != b").distinct(), "edges")
    found = stored(roots.select(*keys, "node").distinct(), "reached")
    # a node with one predecessor is reached with it; roots are reached anyway
    alone = e.groupBy(*keys, "b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").select(*keys, "a", "b")
    alone = alone.join(_right(found, keys, _n="node"), _on(keys, ("b", "_n")), "left_anti")
    heads = resolved(alone, keys, "b", "a")
    heads = stored(heads.where("last is not null").select(*keys, F.col("b").alias("node"), F.col("last").alias("head")), "heads")
    lifted = e.join(_right(heads, keys, _n="node", _head="head"), _on(keys, ("a", "_n")), "left").select(*keys, F.coalesce("_head", "a").alias("a"), "b")
    lifted = stored(lifted.join(_right(heads, keys, _n="node"), _on(keys, ("b", "_n")), "left_anti").where("a != b").distinct(), "edges")
    new = found
    while not new.isEmpty():
        step = lifted.join(_right(new, keys, _n="node"), _on(keys, ("a", "_n")), "left_semi").select(*keys, F.col("b").alias("node")).distinct()
        new = stored(step.join(_right(found, keys, _n="node"), _on(keys, ("node", "_n")), "left_anti"), "reached")
        found = stored(found.union(new), "reached")
    below = heads.join(_right(found, keys, _n="node"), _on(keys, ("head", "_n")), "left_semi").select(*keys, "node")
    return found.union(below).distinct()


def released(before: DataFrame, after: DataFrame, keys: list[str], target: str = "to") -> DataFrame:
    """keys, target: what ``before`` refers to and ``after`` doesn't any more; both are edges."""
    gone = before.select(*keys, F.col(target)).where(F.col(target).isNotNull()).distinct()
    return gone.join(_right(after, keys, _to=target), _on(keys, (target, "_to")), "left_anti")


def uses(edges: DataFrame, keys: list[str], source: str = "from", target: str = "to") -> DataFrame:
    """keys, target, n: how many different nodes refer to each node."""
    return edges.where(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count_distinct(source).alias("n"))
