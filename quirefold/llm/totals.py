"""Running totals over a whole table in a global order, without a task that sees all rows.

Rows are dealt into ranges of the order and written; each range adds up its own rows, and what the ranges before it hold
is one row a range, whose number is the session's number of shuffle partitions at most. Nothing depends on how many
rows a key has: a hot key is cut by the later columns of the order, so give one that tells equal rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import written

PART = "_qf_part"


def running(df: DataFrame, order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """``df`` with, for each of ``values``, its sum over all rows before this one in ``order`` (0 for the first).

    Values are never null. ``name`` names the table that is written. Rows that ``order`` doesn't tell apart are taken
    in any order; ``df`` must give the same rows when it is read twice, so it is best a written table.
    """
    own = {f"_qf_v{i}": value for i, value in enumerate(values.values())}
    ranged = df.select("*", *[v.alias(k) for k, v in own.items()]).repartitionByRange(*order)
    ranged = written(ranged.withColumn(PART, F.spark_partition_id()), name)
    sums = ranged.groupBy(PART).agg(*[F.sum(k).alias(k) for k in own])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(PART).alias("_qf_of"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_ranges") for k in own])
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.join(F.broadcast(offsets), F.col(PART) == F.col("_qf_of"))
    totals = [(F.col(f"{k}_ranges") + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias(n) for n, k in zip(values, own)]
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *totals)
