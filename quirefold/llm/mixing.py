"""Mixing sources to target weights by weighted fair queueing (operator 11, DataFrame functions only).

Each source is a queue of its documents in shuffled order (by a hash of the id), followed by the same queue again as
often as a document may repeat. A copy's virtual finish time is the number of its source's words up to and with it,
divided by the source's weight. All copies are sorted by finish time, over all sources, and taken until the budget of
words is used up; of the copy at the limit only the words that still fit are taken. A source whose queue ends early
leaves its share to the others by their weights, which is how targets are defined, too.

Plan: the texts are read once, for their sizes; a row of some 50 bytes a document is written. Three running totals
(``totals.running``) number the sources, add up words by source and add up words by finish time; each deals rows by
range, so neither a source nor a time is one task's. The table of sources is broadcast if it is short (counted), or
joined by source, where a hot one is split by the adaptive skew join. The driver sees totals only.

Defined results: null text has size 0; size 0 is never taken (taken 0); null source is a source of its own, behind all
others; null ids are shuffled as an empty one, in order of size; repeated rows are documents of their own; sources
without words have target 0; ties in finish time go by source, pass, hash, id and size; rows equal in all of these are
interchangeable; no words at all: every target and taken is 0; an empty table: no rows; other columns, whatever their
names, play no part in ``schedule`` and pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import ROW, whole_row, written
from quirefold.llm.totals import running

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def shuffled(key: Column, seed: int) -> Column:
    """60 bits of a hash of the id."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, passes: int = 2) -> DataFrame:
    """source, source_size, rank, start (words of the sources before it), weight, target, budget (of all sources, in words).

    ``sizes`` has source and size. Targets share ``share`` of all words by weight; none is above ``passes`` times its
    source's size, and what is above goes to the others by weight. The level, words for a weight of one, is the
    largest of (words left / weight left) over the sources in the order in which they fill up.
    """
    sources = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    by_name = [F.col("source").asc_nulls_last()]
    named = running(sources, by_name, {"rank": F.lit(1).cast("long"), "start": F.col("source_size")}, "source_ranks")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    named = written(named.withColumn("weight", weight), "source_weights")
    full = (passes * F.col("source_size")).cast("double")
    filled = running(named, [full / F.col("weight"), F.col("rank")], {"words": passes * F.col("source_size"), "light": F.col("weight")}, "source_levels")
    total, all_weight = named.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = min(share, passes) * (total or 0)
    level = filled.agg(F.max((F.lit(float(budget)) - F.col("words")) / (F.lit(all_weight) - F.col("light")))).first()[0] or 0.0
    return named.select("source", "source_size", "rank", "start", "weight", F.least(full, F.lit(level) * F.col("weight")).alias("target"), F.lit(int(budget)).alias("budget"))


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, passes: int = 2, broadcast_sources: int = 10_000) -> DataFrame:
    """``rows`` (row, key, source, size, h: a written table) once a pass, with source_size, target, pass, finish,
    position (words of the mix before this copy) and taken (words the mix takes of it)."""
    known = written(targets(rows, weights, share, passes), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("h"), F.col("key"), F.col("size"), F.col("row")]
    queued = running(rows, order, {"upto": F.col("size")}, "queues")
    few = known.count() <= broadcast_sources
    named = known.withColumnRenamed("source", "_qf_source")
    joined = queued.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_qf_source"))).drop("_qf_source")
    each = joined.withColumn("pass", F.explode(F.array(*[F.lit(k).cast("long") for k in range(passes)])))
    finish = (F.col("pass") * F.col("source_size") + F.col("upto") - F.col("start") + F.col("size")) / F.col("weight")
    timed = written(each.withColumn("finish", finish).drop("upto", "start", "weight"), "finish_times")
    sent = running(timed, [F.col(c) for c in ("finish", "rank", "pass", "h", "key", "size", "row")], {"position": F.col("size")}, "sent")
    return sent.withColumn("taken", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("position"))).cast("long"))


def _rows(docs: DataFrame, key: str, text: str, source: str, seed: int, row: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(row.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), size.alias("size"), shuffled(F.col(f"`{key}`"), seed).alias("h"))


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document, in no order. ``shares``: as of ``copies``."""
    rows = written(_rows(docs, key, text, source, seed, F.monotonically_increasing_id()), "sizes")
    each = copies(rows, **shares).groupBy("row", "key", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return each.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, **shares) -> DataFrame:
    """The mix itself: all columns of ``docs`` for each copy taken, then pass, position and taken, sorted by position.

    The texts are written once with a row number and sorted once. taken is below the size for the last copy at most.
    """
    whole = written(whole_row(docs, _qf_id=F.monotonically_increasing_id()), "mixed")
    inner = whole.select("_qf_id", f"{ROW}.*")
    rows = written(_rows(inner, key, text, source, seed, F.col("_qf_id")), "sizes")
    sent = copies(rows, **shares).where("taken > 0").select(F.col("row").alias("_qf_copy"), "pass", "position", "taken")
    both = whole.join(sent, F.col("_qf_id") == F.col("_qf_copy")).orderBy("position")
    kept = [F.col(f"{ROW}.`{c}`") for c in docs.columns if c not in ("pass", "position", "taken")]
    return both.select(*kept, "pass", "position", "taken")
