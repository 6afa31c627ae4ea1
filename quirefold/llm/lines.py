"""Site-relative line dedup (operator 2).

A line is boilerplate on a host if more than ``max_ratio`` of the host's pages contain it, and at least
``min_pages`` pages do. Each page counts a line once. Boilerplate lines are dropped from the host's pages; the other
lines stay as they are, in order. Without ``count_copies`` pages of a host with the same text count as one page, both
for the line and for the host, so that a large group of copies doesn't make its own text boilerplate.

Plan: lines are identified by two 64-bit hashes and counted with map-side partial sums, so a hot line or host costs
a row per task. A host has at most (mean lines per page / ``max_ratio``) boilerplate lines, so they are gathered to
one short array per host. That table is written to the shared folder and measured: up to ``broadcast_lines`` lines
it is broadcast, beyond that it is joined by host, where a hot host is split by the adaptive skew join.

Defined results: null host -> the page stays as it is; null text stays null; lines without a word are never dropped;
a page whose lines all go has empty text; repeated rows are pages of their own; a line exactly at the ratio stays; other
columns, whatever their names, pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import ROW, whole_row, written


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 3, count_copies: bool = True) -> DataFrame:
    """host, n_pages, keys: the hashes of the host's boilerplate lines."""
    rows = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("t"))
    once = (lambda df: df) if count_copies else (lambda df: df.distinct())
    page = [] if count_copies else [_key(F.col("t")).alias("page")]
    totals = once(rows.select("host", *page)).groupBy("host").agg(F.count("*").alias("n_pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"\S")), _key))
    counts = once(rows.select("host", *page, F.explode(lines).alias("k"))).groupBy("host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, "host").where(F.col("n") > F.col("n_pages") * max_ratio)
    return often.groupBy("host").agg(F.max("n_pages").alias("n_pages"), F.collect_list("k").alias("keys"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 3, broadcast_lines: int = 100_000, count_copies: bool = True) -> DataFrame:
    """All columns of ``pages`` with the cleaned text, then n_lines and n_dropped (replaced if the input has them)."""
    found = written(boilerplate(pages, host, text, max_ratio, min_pages, count_copies), "boilerplate").withColumnRenamed("host", "_qf_host").select("_qf_host", "keys")
    size = found.agg(F.sum(F.size("keys"))).first()[0] or 0
    rows = whole_row(pages, _qf_h=F.col(host), _qf_t=F.col(text))
    joined = rows.join(F.broadcast(found) if size <= broadcast_lines else found, F.col("_qf_h") == F.col("_qf_host"), "left")
    lines = F.split("_qf_t", "\n")
    kept = F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("keys", _key(x))))
    cleaned = joined.select(ROW, "_qf_t", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_qf_n"), kept.alias("_qf_kept"))
    others = [F.col(f"{ROW}.`{c}`") if c != text else F.array_join("_qf_kept", "\n").alias(text) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    n = F.when(F.col("_qf_t").isNull(), 0).otherwise(F.col("_qf_n")).cast("long")
    left = F.when(F.col("_qf_t").isNull(), 0).otherwise(F.size("_qf_kept")).cast("long")
    return cleaned.select(*others, n.alias("n_lines"), (n - left).alias("n_dropped"))
