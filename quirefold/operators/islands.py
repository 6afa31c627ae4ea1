"""Gaps and islands: ordered rows that continue the row before them form one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str | Column], continues, name: str = "island") -> DataFrame:
    """``df`` with a running group number per key.

    ``continues(previous)`` is a condition in which ``previous(column)`` is the row before; null counts as false.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.coalesce(continues(lambda c: F.lag(c).over(w)), F.lit(False))).cast("int")
    marked = df.withColumn("_qf_new", new)
    return marked.withColumn(name, F.sum("_qf_new").over(w)).drop("_qf_new")


def in_force(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """The last value that wasn't null, this row's included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_in_force(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """The next value after this row that isn't null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(w))


def before(df: DataFrame, keys: list[str], order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """The running sum of the rows before this one: offsets, cursors, bounds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in an order that has no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_qf_rank", F.row_number().over(w)).where(F.col("_qf_rank") <= k).drop("_qf_rank")
