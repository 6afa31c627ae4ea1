"""Edits of lines: which run gets the new text, how the old operators are silenced, and the splice into the bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.geometry import number_text

#: The smallest factors of the two ways to make a line fit, and the excess that is worth a warning.
SHRINK, CONDENSE, EXCESS = 0.4, 0.6, 1.001


def spread(run_texts: list[str], new: str) -> tuple[list[str], int]:
    """The new text over the old runs: (texts, index of the run that got the insertion, -1 if nothing changed).

    What is equal at both ends stays where it is; the middle goes to the first run that the removed range touches, or,
    for a pure insertion, to the last run that ends at or holds the caret.
    """
    old = "".join(run_texts)
    if old == new:
        return list(run_texts), -1
    most, head = min(len(old), len(new)), 0
    while head < most and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < most - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    lo, hi, middle = head, len(old) - tail, new[head : len(new) - tail]
    ends = [sum(len(t) for t in run_texts[: k + 1]) for k in range(len(run_texts))]
    bounds = [(e - len(t), e) for e, t in zip(ends, run_texts)]
    if hi > lo:
        owner = next((k for k, (a, b) in enumerate(bounds) if a < hi and b > lo), 0)
    else:
        owner = next((k for k in reversed(range(len(bounds))) if bounds[k][0] < lo <= bounds[k][1]), 0)
    out = []
    for k, ((a, b), text) in enumerate(zip(bounds, run_texts)):
        left, right = text[: max(0, min(lo, b) - a)], text[max(0, hi - a) :] if hi < b else ""
        out.append(left + (middle if k == owner else "") + right)
    return (out or [new]), owner


def _distributed(run_texts: pd.Series, new: pd.Series) -> pd.DataFrame:
    found = [spread([x or "" for x in (r if r is not None else [])], n or "") for r, n in zip(run_texts, new)]
    return pd.DataFrame({"texts": [x[0] for x in found], "owner": [x[1] for x in found]})


def distribute(lines: DataFrame, run_texts: str, new_text: str) -> DataFrame:
    """``lines`` with texts (one per run) and owner (-1: unchanged). Null texts count as empty."""
    return lines.withColumn("_qf_d", F.pandas_udf(_distributed, "struct<texts:array<string>,owner:int>")(run_texts, new_text)).withColumns({"texts": F.col("_qf_d.texts"), "owner": F.col("_qf_d.owner")}).drop("_qf_d")


def source_text(content: Column, start: Column, end: Column) -> Column:
    """The bytes of an operator as text."""
    return F.decode(F.substring(content, (start + 1).cast("int"), (end - start).cast("int")), "ISO-8859-1")


def conflicts(replacements: DataFrame, keys: list[str], start: str = "start", end: str = "end", ties: tuple[str, ...] = ()) -> DataFrame:
    """Replacements that begin before an earlier one of the same stream has ended; of equal ones the first by ``ties`` is earlier."""
    w = Window.partitionBy(*keys).orderBy(start, end, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return replacements.withColumn("_qf_end", F.max(end).over(w)).where(F.col("_qf_end") > F.col(start)).drop("_qf_end")


def splice(streams: DataFrame, replacements: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``streams`` with the byte ranges [start, end) replaced by ``bytes``; equal replacements count once.

    Replacements of a stream must not overlap (see ``conflicts``) and must lie inside it; such a stream keeps its bytes.
    """
    one = replacements.select(*keys, "start", "end", "bytes").distinct()
    listed = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "bytes"))).alias("_qf_r"))
    joined = streams.join(listed, keys, "left")
    r, data = F.col("_qf_r"), F.col(content)
    text = lambda x: F.decode(x, "ISO-8859-1")  # noqa: E731  one character a byte, and back

    def piece(x: Column, i: Column) -> Column:
        last = F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1)["end"])
        return F.concat(text(F.substring(data, (last + 1).cast("int"), (x["start"] - last).cast("int"))), text(x["bytes"]))

    tail = text(F.substring(data, (F.element_at(r, -1)["end"] + 1).cast("int"), F.lit(2**31 - 1)))
    fine = F.forall(F.transform(r, lambda x, i: (x["start"] >= F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1)["end"])) & (x["end"] >= x["start"]) & (x["end"] <= F.octet_length(data))), lambda ok: ok)
    return joined.withColumn(content, F.when(r.isNull() | ~fine, data).otherwise(F.encode(F.concat(F.array_join(F.transform(r, piece), ""), tail), "ISO-8859-1"))).drop("_qf_r")


def refused(streams: DataFrame, replacements: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, start, end, reason (overlap, outside) of the replacements for which ``splice`` leaves a stream as it is; outside
    also counts those of streams that aren't there."""
    one = replacements.select(*keys, "start", "end", "bytes").distinct()
    late = conflicts(one, keys, ties=("bytes",)).select(*keys, "start", "end", F.lit("overlap").alias("reason"))
    sizes = one.join(streams.select(*keys, F.octet_length(content).alias("_qf_size")), keys, "left")
    fits = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("_qf_size"))
    return late.union(sizes.where(~F.coalesce(fits, F.lit(False))).select(*keys, "start", "end", F.lit("outside").alias("reason")))


#: What ``silenced`` reads of a run.
NEEDED = ["op", "safe_delete", "font_size", "char_spacing", "word_spacing", "horiz_scale", "render_mode", "width_sum", "n_glyphs", "n_spaces", "tj_adjustment", "n_bytes"]


def pruned(edits: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Edits that change something: another text, or another way to fit than to keep the size and start at the left."""
    joined = edits.join(lines.select(*keys, F.col("text").alias("_qf_old")), keys)
    return joined.where(~(F.col("new_text").eqNullSafe(F.col("_qf_old")) & (F.col("overflow") == "keep") & (F.col("anchor") == "left"))).drop("_qf_old")


def allowed(original: Column) -> Column:
    """The width up to which a line has no excess: ``EXCESS`` as the decimal that it is, not as the double just below it."""
    return original * round(EXCESS * 1000) / 1000


def fit_check(width: Column, original: Column, unmapped: Column) -> Column:
    """struct<width,original,fits,needs_fallback>: whether an edited text fits its line, and whether its font can draw it."""
    return F.struct(width.alias("width"), original.alias("original"), (width <= allowed(original)).alias("fits"), (F.size(unmapped) > 0).alias("needs_fallback"))


def silenced(run: str = "", original: Column | None = None) -> Column:
    """struct<mode,text>: what stands in for a text-showing operator so that it draws nothing but moves as before.

    ``original`` is the operator's own text, which stays, invisible, where its movement can't be computed; without it
    the text of such rows lacks it, and the caller has to put it in. An operator whose strings are empty moves by its
    adjustments alone; one whose strings give no glyphs, as without a font, can't be computed.

    Columns: op, safe_delete, font_size, char_spacing, word_spacing, horiz_scale, render_mode, width_sum, n_glyphs,
    n_spaces, tj_adjustment, n_bytes.
    """
    c = lambda n: F.col(f"{run}{n}")
    size = c("font_size")
    moved = -c("width_sum") - 1000 * c("n_glyphs") * c("char_spacing") / size - 1000 * c("n_spaces") * c("word_spacing") / size + c("tj_adjustment")
    first = F.when(c("op") == "'", "T* ").when(c("op") == '"', F.concat(number_text(c("word_spacing")), F.lit(" Tw "), number_text(c("char_spacing")), F.lit(" Tc T* "))).otherwise("")
    mode = F.when(c("safe_delete"), "delete").when((size == 0) | ((c("n_glyphs") == 0) & (c("n_bytes") > 0)), "invisible").otherwise("adjust")
    text = F.when(mode == "delete", first).when(mode == "adjust", F.concat(first, F.lit("["), number_text(moved), F.lit("] TJ")))
    hidden = F.concat(F.when(c("render_mode") >= 4, "7 Tr ").otherwise("3 Tr "), original if original is not None else F.lit(""), F.format_string(" %d Tr", c("render_mode")))
    return F.struct(mode.alias("mode"), F.coalesce(text, hidden).alias("text"))


def fitted(width: Column, original: Column, how: Column, anchor: Column) -> Column:
    """struct<size_factor,scale_factor,offset,overflow>: shrink or condense a line that has become wider."""
    over = width > original
    wanted = original / width
    size = F.when(over & (how == "shrink"), F.greatest(F.lit(SHRINK), wanted)).otherwise(1.0)
    scale = F.when(over & (how == "condense"), F.greatest(F.lit(CONDENSE), wanted)).otherwise(1.0)
    final = width * size * scale
    offset = F.when(anchor == "center", (original - final) / 2).when(anchor == "right", original - final).otherwise(0.0)
    return F.struct(size.alias("size_factor"), scale.alias("scale_factor"), offset.alias("offset"), (final > allowed(original)).alias("overflow"))
