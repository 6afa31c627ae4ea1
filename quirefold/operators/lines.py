"""Text runs to lines of text, with windows and ordered aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.geometry import half_up
from quirefold.operators.islands import islands
from quirefold.operators.summary import shared, spaced_pieces

#: Largest step across, largest size ratio, largest gap and largest step back within a line, in em, and
#: the gap from which a blank is put between runs.
ACROSS, RATIO, GAP, BACK, BLANK = 0.45, 2.5, 2.5, 0.6, 0.18


#: What ``group_lines`` reads of the runs.
NEEDED = ["run_seq", "stream_key", "ctm", "angle", "x", "y", "x0", "y0", "x1", "y1", "advance", "text_to_page", "render_mode", "text", "effective_size", "font_name", "fill", "n_glyphs", "vertical"]


def projected(runs: DataFrame) -> DataFrame:
    """Runs with along and across the baseline, their far end, and the bucket that lines never cross."""
    cos, sin = F.cos("angle"), F.sin("angle")
    along, across = F.col("x") * cos + F.col("y") * sin, F.col("y") * cos - F.col("x") * sin
    matrix = F.array_join(F.transform("ctm", lambda v: ((half_up(v * 1000) / 1000) + 0.0).cast("string")), " ")
    return runs.withColumns(
        {
            "along": along,
            "across": across,
            "far": along + F.col("advance") * F.col("text_to_page"),
            "bucket": F.concat_ws("|", "stream_key", matrix, half_up(F.degrees("angle")).cast("string")),
        }
    )


def page_space(runs: DataFrame, geometry: DataFrame) -> DataFrame:
    """``runs`` with their display geometry relative to the visible box of their page; geometry: doc_id, page_index, offset_x, offset_y."""
    joined = runs.join(geometry.select("doc_id", "page_index", F.col("offset_x").alias("_qf_x"), F.col("offset_y").alias("_qf_y")), ["doc_id", "page_index"])
    moved = {c: F.col(c) - F.col("_qf_x" if c[0] == "x" else "_qf_y") for c in ("x", "y", "x0", "y0", "x1", "y1") if c in runs.columns}
    return joined.withColumns(moved).drop("_qf_x", "_qf_y")


def editable(lines: DataFrame) -> DataFrame:
    """Lines that nothing blocks."""
    return lines.where(F.size("blockers") == 0)


def run_blockers(shared: Column | None = None) -> Column:
    """What keeps a run from being edited, as an array."""
    mode = F.col("render_mode")
    found = F.array(
        F.when(mode.isin(3, 7), "invisible").when(mode >= 4, "clipping-mode"),
        F.when(F.col("vertical"), "vertical"),
        F.when(F.regexp_replace("text", r"[\s\p{Z}\x{FEFF}]", "") == "", "no-unicode"),
        F.when(F.lit(False) if shared is None else shared, "shared-xobject"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def in_reading_order(df: DataFrame, keys: list[str], page: list[str], height: str, ties: list[str]) -> DataFrame:
    """``df`` with line_seq: by page, from the top down, then by the ties."""
    return df.withColumn("line_seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*page, F.desc(height), *ties)))


def group_lines(runs: DataFrame, shared_streams: DataFrame | None = None) -> DataFrame:
    """doc_id, page_index, line_seq (reading order), text, run_seqs, n_runs, x, y, width, size, font_name, fill, blockers, box.

    shared_streams: doc_id, stream_key of streams that more than one page shows.
    """
    rows = projected(runs)
    rows = rows if "vertical" in rows.columns else rows.withColumn("vertical", F.lit(False))
    if shared_streams is not None:
        marks = shared_streams.select("doc_id", "stream_key").distinct().withColumn("_qf_shared", F.lit(True))
        rows = rows.join(marks, ["doc_id", "stream_key"], "left").withColumn("blockers", run_blockers(F.col("_qf_shared").isNotNull()))
    else:
        rows = rows.withColumn("blockers", run_blockers())
    keys = ["doc_id", "page_index", "bucket"]

    def continues(prev) -> Column:
        size, last = F.col("effective_size"), prev("effective_size")
        em = F.greatest(size, last, F.lit(1e-6))
        gap = F.col("along") - prev("far")
        return (F.abs(F.col("across") - prev("across")) <= em * ACROSS) & (F.greatest(size, last) <= F.least(size, last) * RATIO) & (gap <= em * GAP) & (gap > -em * BACK)

    rows = islands(rows, keys, ["across", "along", "run_seq"], continues)
    part = F.struct("along", "across", "run_seq", "far", "text", "effective_size", "font_name", "fill", "x", "y", "angle", utf16_length(F.col("text")).alias("units"), "n_glyphs", "blockers")
    lines = rows.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(part)).alias("p"), F.min("run_seq").alias("first"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))

    apart = lambda r, nxt: nxt["along"] - r["far"] > F.greatest(r["effective_size"], F.lit(1e-6)) * BLANK
    lines = lines.withColumn("run_texts", spaced_pieces(F.col("p"), lambda r: r["text"], apart)).withColumn("text", F.array_join("run_texts", ""))
    strongest = F.element_at(F.array_sort(F.transform("p", lambda r, i: F.struct((-r["units"]).alias("u"), i.alias("i"), r.alias("r")))), 1)["r"]
    lines = lines.withColumn("main", strongest)
    all_blockers = F.array_distinct(F.flatten(F.transform("p", lambda r: r["blockers"])))
    sums = lambda f: F.aggregate("p", F.lit(0).cast("long"), lambda s, r: s + r[f])
    mapped = (F.trim("text") != "") & (sums("units") > 0.6 * sums("n_glyphs"))
    found = lines.select(
        "doc_id",
        "page_index",
        "text",
        "run_texts",
        F.transform("p", lambda r: r["run_seq"]).alias("run_seqs"),
        F.size("p").alias("n_runs"),
        F.get("p", F.lit(0))["x"].alias("x"),
        F.get("p", F.lit(0))["y"].alias("y"),
        F.greatest(F.lit(0.0), F.element_at("p", -1)["far"] - F.get("p", F.lit(0))["along"]).alias("width"),
        F.col("main.effective_size").alias("size"),
        F.col("main.font_name").alias("font_name"),
        F.col("main.fill").alias("fill"),
        F.when(mapped, F.array_remove(all_blockers, "no-unicode")).otherwise(all_blockers).alias("blockers"),
        F.struct("x0", "y0", "x1", "y1").alias("box"),
        "first",
    )
    return in_reading_order(found, ["doc_id"], ["page_index"], "y", ["x", "first"]).drop("first")


def shared_streams(uses: DataFrame) -> DataFrame:
    """doc_id, stream_key of the streams that several pages show; uses: doc_id, page_index, stream_key."""
    return shared(uses, ["doc_id", "stream_key"], "page_index").select("doc_id", "stream_key")
