"""Warnings about documents as rows: doc_id, page_index (null: the whole document), code, level.

Each is an aggregate over tables that reading and grouping make anyway; nothing is read again but those. Levels: error
(nothing can be done), warn (something is locked or will change), info.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, code: Column | str, level: str, page: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select("doc_id", (F.lit(None) if page is None else page).cast("int").alias("page_index"), code.alias("code"), F.lit(level).alias("level"))


def repeated_streams(runs: DataFrame) -> DataFrame:
    """doc_id, stream_key of forms that several pages show, or that are shown more than once: an edit would change all copies."""
    forms = runs.where(F.col("stream_key").startswith("xobj:"))
    spans = forms.groupBy("doc_id", "stream_key", "start").agg(F.count("*").alias("n"))
    pages = forms.groupBy("doc_id", "stream_key").agg(F.count_distinct("page_index").alias("n"))
    return spans.where("n > 1").select("doc_id", "stream_key").union(pages.where("n > 1").select("doc_id", "stream_key")).distinct()


def load_warnings(pages: DataFrame, runs: DataFrame, lines: DataFrame) -> DataFrame:
    """What reading a document has found: encrypted, parse or empty (no more is known of it then), content-decode, text-clip,
    shared-xobject, no-text, no-editable-text, signed.

    pages: doc_id, page_index and, if there, warning, issues, signed; runs: doc_id, page_index, stream_key, start,
    render_mode; lines: doc_id, blockers. A document whose lines are all blocked has no editable text.
    """
    have = set(pages.columns)
    read = pages.where("warning IS NULL") if "warning" in have else pages
    found = _rows(runs.where("render_mode >= 4").select("doc_id", "page_index").distinct(), "text-clip", "info", F.col("page_index"))
    found = found.union(_rows(repeated_streams(runs).select("doc_id").distinct(), "shared-xobject", "warn"))
    editable = lines.groupBy("doc_id").agg(F.count_if(F.size("blockers") == 0).alias("n"))
    shown = runs.select("doc_id").distinct().withColumn("shows", F.lit(True))
    states = read.select("doc_id").distinct().join(editable, "doc_id", "left").join(shown, "doc_id", "left")
    nothing = F.when(F.col("shows"), "no-editable-text").otherwise("no-text")
    found = found.union(_rows(states.where(F.coalesce("n", F.lit(0)) == 0), nothing, "error"))
    if "warning" in have:
        found = found.union(_rows(pages.where("warning IS NOT NULL"), F.col("warning"), "error"))
    if "issues" in have:
        found = found.union(_rows(read.where(F.array_contains("issues", "content-decode")), "content-decode", "warn", F.col("page_index")))
    if "signed" in have:
        found = found.union(_rows(read.where("signed").select("doc_id").distinct(), "signed", "warn"))
    return found
