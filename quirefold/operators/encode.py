"""From edited text back to the bytes of a font, and from edits of lines to edited pages.

Fonts are specifications (JSON, as ``Font`` takes it). Texts are encoded in one narrow Arrow pass by compiled fonts
(``functions.trie``); the reverse map is also there as a table. The drawing block of a line and the splice into the
page's bytes are built-in expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirefold.functions.cmap import Font
from quirefold.functions.geometry import hex_text, number_text
from quirefold.functions.lexer import Name, operations
from quirefold.functions.trie import LONGEST, Encoder
from quirefold.operators import edit
from quirefold.operators.islands import top_per_key
from quirefold.operators.stored import stored

REPERTOIRE = "font string, code int, byte_len int, unicode string, width double, rank int"
#: The font that draws what a page's own font can't, and the name that pages give it.
FALLBACK, FALLBACK_NAME = json.dumps({"base": "Helvetica", "encoding": "cp1252"}), "QfFallback"


def repertoire(fonts: DataFrame) -> DataFrame:
    """One row per code that a font can write; fonts: font (specification), repeated ones count once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for spec in batch["font"]:
                yield pd.DataFrame([(spec, *r) for r in Font(json.loads(spec)).repertoire()], columns=["font", "code", "byte_len", "unicode", "width", "rank"])

    return fonts.select("font").where("font is not null").distinct().mapInPandas(rows, REPERTOIRE)


def usable_key(text: Column) -> Column:
    """One character, or two to four letters as ligatures are spelled."""
    return (F.char_length(text) == 1) | text.rlike(rf"^\p{{L}}{{2,{LONGEST}}}$")


def code_bytes(code: Column, byte_len: Column) -> Column:
    """A code as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(code), (2 * byte_len).cast("int"), F.lit("0")))


def code_number(data: Column) -> Column:
    """Big-endian bytes, four at most, as a number."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def reverse_map(codes: DataFrame) -> DataFrame:
    """font, unicode, code, byte_len, width: of several codes of one text the best rank, then the lowest code."""
    return top_per_key(codes.where(usable_key(F.col("unicode"))), ["font", "unicode"], [F.col("rank"), F.col("code")]).select("font", "unicode", "code", "byte_len", "width")


def diagnostics(fonts: DataFrame) -> DataFrame:
    """font, repertoire (different texts it can write), reusable: one row per different font."""
    sizes = reverse_map(repertoire(fonts)).groupBy("font").agg(F.count("*").alias("repertoire"))
    return fonts.select("font").distinct().join(sizes, "font", "left").select("font", F.coalesce("repertoire", F.lit(0)).cast("long").alias("repertoire"), F.col("repertoire").isNotNull().alias("reusable"))


#: What a text is encoded to.
ENCODED = "bytes binary, width double, n_glyphs int, n_spaces int, unmapped array<string>"
_ENCODERS: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """Compiled once per Python worker; few are kept, since an embedded font has up to 65,536 codes."""
    if spec not in _ENCODERS:
        if len(_ENCODERS) >= 64:
            _ENCODERS.pop(next(iter(_ENCODERS)))
        _ENCODERS[spec] = Encoder(Font(json.loads(spec)))
    return _ENCODERS[spec]


def _shown(operator: bytes) -> bytes:
    """The strings of an operator that shows text, joined."""
    flat = [y for o in operations(operator) for x in o.operands for y in (x if isinstance(x, list) else [x])]
    return b"".join(x for x in flat if isinstance(x, bytes) and not isinstance(x, Name))


def _by_hints(own: Encoder, rows: list[int], text: list[str], before: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, tuple]]:
    """(row, what its text is encoded to): rows of equal hints are encoded together, about ``most`` characters at a time."""
    waiting: dict[tuple, tuple[list[int], int]] = {}

    def sent(hints: tuple) -> Iterator[tuple[int, tuple]]:
        ready = waiting.pop(hints)[0]
        return zip(ready, own.encode([text[k] for k in ready], dict(hints)))

    for k in rows:
        hints = tuple(sorted(own.hinted(_shown(before[k])).items())) if before[k] else ()
        ready, size = waiting.get(hints, ([], 0))
        ready.append(k)
        waiting[hints] = ready, size + len(text[k])
        if waiting[hints][1] > most:
            yield from sent(hints)
    for hints in list(waiting):
        yield from sent(hints)


def encoded(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, font, text, bytes, width (thousandths), n_glyphs, n_spaces, unmapped: the text in the codes of its font.

    At each position the longest key counts; a character without one goes by its stand-ins, else it is unmapped and has
    no bytes. texts: keys, font, text and, if they have it, source: the operator (its bytes) that showed a text there in
    this font before; the first code it has for a character is taken again. One pass, no shuffle; work and memory follow the length of the texts.
    Defined results: null or empty text has no bytes; null font: everything is unmapped.
    """
    kept = [*keys, "font", "text"]
    before = F.col("source") if "source" in texts.columns else F.lit(None).cast("binary")
    source = texts.select(*kept, before.alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            font, text, before = batch.columns[-3], batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist()
            numbered = font.dictionary_encode()
            specs, which = numbered.dictionary.to_pylist(), numbered.indices.to_pylist()
            out: list[tuple] = [(b"", 0.0, 0, 0, list(t or "")) for t in text]
            for n, spec in enumerate(specs):
                for k, found in _by_hints(_encoder(spec), [k for k, m in enumerate(which) if m == n and text[k]], text, before):
                    out[k] = found
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    schema = StructType([*source.drop("source").schema, *StructType.fromDDL(ENCODED)])
    return source.mapInArrow(run, schema)


def name_token(name: Column) -> Column:
    """A name with its slash; what is no regular character becomes #XX."""
    piece = lambda c: F.when(c.rlike(r"^[!-~&&[^()<>\[\]{}/%#]]$"), c).otherwise(F.concat(F.lit("#"), F.upper(F.lpad(F.hex(F.ascii(c)), 2, "0"))))
    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(name, ""), lambda c: c != ""), piece), ""))


def advance(segment: Column, scale: Column, char: Column, word: Column) -> Column:
    """How far a segment moves the pen in text space."""
    return (segment["width"] / 1000 * segment["size"] + segment["n_glyphs"] * char + segment["n_spaces"] * word) * scale


def advances(segments: Column, scale: Column, char: Column, word: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda s, x: s + advance(x, scale, char, word))


def draw_block(segments: Column, ctm: Column, tm: Column, scale: Column, char: Column, word: Column, rise: Column, mode: Column, offset: Column, stroke: Column | None = None, line_width: Column | None = None) -> Column:
    """A self-contained block of operators that draws segments (font, size, fill, bytes, width, n_glyphs, n_spaces).

    Each segment is placed by its own matrix; the fill is set where it changes. ``stroke`` (red, green, blue) and
    ``line_width`` count in the render modes that draw outlines (1 and 2).
    """
    numbers = lambda a: F.array_join(F.transform(a, number_text), " ")

    def part(state: Column, x: Column) -> Column:
        cursor = state["cursor"]
        fill = F.when(x["fill"].isNotNull() & ~state["fill"].eqNullSafe(x["fill"]), F.concat(numbers(x["fill"]), F.lit(" rg\n"))).otherwise("")
        placed = F.concat(F.array(*[tm[k] for k in range(4)]), F.array(tm[4] + cursor * tm[0], tm[5] + cursor * tm[1]))
        text = F.concat(fill, name_token(x["font"]), F.lit(" "), number_text(x["size"]), F.lit(" Tf\n"), numbers(placed), F.lit(" Tm\n"), hex_text(x["bytes"]), F.lit(" Tj\n"))
        return F.struct((cursor + advance(x, scale, char, word)).alias("cursor"), F.coalesce(x["fill"], state["fill"]).alias("fill"), F.array_append(state["parts"], text).alias("parts"))

    start = F.struct(offset.cast("double").alias("cursor"), F.lit(None).cast("array<double>").alias("fill"), F.array().cast("array<string>").alias("parts"))
    drawn = F.aggregate(segments, start, part, lambda s: F.array_join(s["parts"], ""))
    colour = F.lit("") if stroke is None else F.when(stroke.isNotNull(), F.concat(numbers(stroke), F.lit(" RG\n"))).otherwise("")
    width = F.lit("") if line_width is None else F.concat(number_text(line_width), F.lit(" w\n"))
    pen = F.when(mode.isin(1, 2), F.concat(colour, width)).otherwise("")
    state = F.concat(number_text(char), F.lit(" Tc\n"), number_text(word), F.lit(" Tw\n"), number_text(scale * 100), F.lit(" Tz\n"), F.when(rise != 0, F.concat(number_text(rise), F.lit(" Ts\n"))).otherwise(""), F.when(mode != 0, F.concat(mode.cast("string"), F.lit(" Tr\n"))).otherwise(""), pen)
    block = F.concat(F.lit("q\n"), numbers(ctm), F.lit(" cm\nBT\n"), state, drawn, F.lit("ET\nQ"))
    return F.when(F.size(segments) == 0, "").otherwise(block)


def wrapped(content: Column, block: Column) -> Column:
    """Page content as it was, between q and Q, and a block behind it."""
    return F.concat(F.encode(F.lit("q\n"), "ISO-8859-1"), content, F.encode(F.concat(F.lit("\nQ\n"), block, F.lit("\n")), "ISO-8859-1"))


def _streams(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, stream_key, content, fonts of each page and of the forms that it shows."""
    page = ["doc_id", "page_index"]
    own = pages.select(*page, F.concat(F.lit("page:"), F.col("page_index").cast("string")).alias("stream_key"), "content", "fonts")
    if "forms" not in pages.columns:
        return own
    each = pages.select(*page, F.col("fonts").alias("outer"), F.explode("forms").alias("name", "form"))
    key = F.concat(F.lit("xobj:"), F.when(F.coalesce(F.col("form.key"), F.lit("")) != "", F.col("form.key")).otherwise(F.col("name")))
    each = each.select(*page, key.alias("stream_key"), F.col("form.content").alias("content"), F.coalesce(F.col("form.fonts"), F.col("outer")).alias("fonts"))
    # a form may have several names on a page
    once = each.groupBy(*page, "stream_key").agg(F.any_value(F.struct("content", "fonts")).alias("s"))
    return own.union(once.select(*page, "stream_key", "s.content", "s.fonts"))


def alias(spec: Column) -> Column:
    """The name that a page gives to a font of one of its forms."""
    return F.concat(F.lit("QfE"), F.substring(F.md5(spec), 1, 12))


#: What an edit has done to a page; ``observed`` adds them up.
COUNTERS = ("lines_changed", "runs_rewritten", "runs_deleted", "reused_font", "fallback_font")


def observed(edited: DataFrame, counters: Observation) -> DataFrame:
    """``edited`` pages, whose counters are added up by whatever action reads them, in the same pass."""
    return edited.observe(counters, *[F.coalesce(F.sum(f"edits.{c}"), F.lit(0)).alias(c) for c in COUNTERS])


def apply_edits(pages: DataFrame, runs: DataFrame, lines: DataFrame, edits: DataFrame, fallback: str | None = FALLBACK) -> tuple[DataFrame, DataFrame]:
    """(pages with the edits applied and, in edits, their counters; a report: doc_id, page_index, line_seq, code, level, detail).

    pages: doc_id, page_index, content, fonts and, if they have them, forms; runs and lines are theirs; edits: doc_id,
    line_seq, new_text, overflow (keep, shrink, condense), anchor (left, center, right). Edits of unknown lines drop out,
    those of blocked lines are reported; the old operators are silenced where they stand, in the page or in a form, and
    the new text is drawn by one block a line behind the page's content, with a form's font under an alias. A form that
    is shown more than once, or that is no object of its own, keeps its text (shared-xobject). ``fallback`` is the font
    (a specification) for what a line's own fonts can't draw; without one such text is left out (no-font). pages, runs and lines are
    read several times: pass written tables; the pieces of the edited lines are written here. Applied to the original pages, the result is the same however often it is made.
    """
    page, line = ["doc_id", "page_index"], ["doc_id", "page_index", "line_seq"]
    stream = [*page, "stream_key"]
    wanted = edits.select("doc_id", "line_seq", "new_text", "overflow", "anchor").join(lines, ["doc_id", "line_seq"])
    report = lambda df, code, level, detail: df.select(*line, F.lit(code).alias("code"), F.lit(level).alias("level"), detail.alias("detail"))
    locked = report(wanted.where(F.size("blockers") > 0), "locked-line", "warn", F.array_join("blockers", ", "))
    changed = edit.distribute(wanted.where(F.size("blockers") == 0), "run_texts", "new_text").where("owner >= 0")
    pieces = changed.select(*line, "overflow", "anchor", F.col("width").alias("line_room"), F.posexplode(F.arrays_zip(F.col("run_seqs").alias("run_seq"), F.col("texts").alias("new"))).alias("pos", "z")).select(*line, "overflow", "anchor", "line_room", "pos", "z.run_seq", F.col("z.new").alias("new"))
    given = set(runs.columns)
    pen = [F.col("line_width") if "line_width" in given else F.lit(1.0), F.col("stroke") if "stroke" in given else F.lit(None).cast("array<double>")]
    pieces = pieces.join(runs.withColumn("pen", pen[0]).withColumn("stroke", pen[1]), [*page, "run_seq"])
    inside = F.col("stream_key").startswith("xobj:")
    often = runs.where(inside).groupBy("doc_id", "stream_key", "start").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "stream_key").distinct()
    formed = pieces.where(inside).select("doc_id", "stream_key", *line[1:]).distinct().join(often.withColumn("often", F.lit(True)), ["doc_id", "stream_key"], "left")
    refused = formed.where(F.col("often") | ~F.col("stream_key").rlike(r"^xobj:\d+ \d+ R$")).select(*line).distinct()
    shared = report(refused, "shared-xobject", "warn", F.lit("text of a form that is shown more than once or is no object"))
    streams = _streams(pages)
    own_bytes = F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    pieces = pieces.join(refused, line, "left_anti").join(streams, stream)
    # no more than the edited lines' runs; everything below reads them
    pieces = stored(pieces.withColumn("font", F.try_element_at("fonts", F.col("font_name"))).withColumn("source", own_bytes).drop("fonts", "content"), "pieces")
    keys = [*line, "pos"]
    texts = pieces.where("new != ''").select(*keys, "font", F.col("new").alias("text"), "source")
    own = stored(encoded(texts.where("font is not null"), keys), "own")
    good = own.where((F.size("unmapped") == 0) & (F.octet_length("bytes") > 0))
    needy = texts.drop("source").join(good.select(*keys), keys, "left_anti")
    other = stored(encoded((needy if fallback else needy.where("false")).withColumn("font", F.lit(fallback or FALLBACK)), keys), "other")
    lost = report(other.where(F.size("unmapped") > 0), "unrenderable", "error", F.array_join(F.array_distinct("unmapped"), ""))
    lacking = own.select(*keys, F.col("unmapped").alias("lack")).join(other.select(*keys, F.col("unmapped").alias("still")), keys)
    substituted = F.array_distinct(F.array_except("lack", "still"))
    swapped = report(lacking.where(F.size(substituted) > 0), "font-substituted", "warn", F.array_join(substituted, ""))
    no_font = report(needy.where(F.lit(fallback is None)), "no-font", "error", F.col("text"))
    given = good.withColumn("own", F.lit(True)).union(other.where(F.octet_length("bytes") > 0).withColumn("own", F.lit(False)))
    name = F.when(~F.col("own"), FALLBACK_NAME).when(inside, alias(F.col("font"))).otherwise(F.col("font_name"))
    facts = F.struct("pos", name.alias("font"), F.col("font_size").alias("size"), "fill", "bytes", F.col("g.width").alias("width"), F.col("g.n_glyphs").alias("n_glyphs"), F.col("g.n_spaces").alias("n_spaces"))
    joined = pieces.join(given.select(*keys, "own", "bytes", F.struct("width", "n_glyphs", "n_spaces").alias("g")), keys, "left")
    anchors = F.min_by(F.struct("ctm", "text_matrix", "horiz_scale", "char_spacing", "word_spacing", "rise", "render_mode", "text_to_page", F.col("line_room").alias("line_width"), "overflow", "anchor", "stroke", F.col("pen").alias("pen")), "pos").alias("at")
    # fonts that the page gets for its blocks
    more = F.when(~F.col("own"), F.struct(F.lit(FALLBACK_NAME).alias("name"), F.lit(fallback or FALLBACK).alias("spec"))).when(inside, F.struct(alias(F.col("font")).alias("name"), F.col("font").alias("spec")))
    per = joined.groupBy(*line).agg(anchors, F.array_sort(F.collect_list(F.when(F.col("bytes").isNotNull(), facts))).alias("segments"), F.collect_set(F.when(F.col("bytes").isNotNull(), more)).alias("more"))
    scale, char, word = F.when(F.col("at.horiz_scale") == 0, 1.0).otherwise(F.col("at.horiz_scale")), F.col("at.char_spacing"), F.col("at.word_spacing")
    per = per.withColumn("room", F.col("at.line_width") / F.col("at.text_to_page")).withColumn("needed", advances(F.col("segments"), scale, char, word))
    fit = edit.fitted(F.col("needed"), F.col("room"), F.when(F.col("room") > 0, F.col("at.overflow")), F.col("at.anchor"))
    per = per.withColumn("fit", fit).withColumn("segments", F.transform("segments", lambda x: x.withField("size", x["size"] * F.col("fit.size_factor"))))
    mode = F.when(F.col("at.render_mode") >= 4, 0).otherwise(F.col("at.render_mode"))
    per = per.withColumn("block", draw_block(F.col("segments"), F.col("at.ctm"), F.col("at.text_matrix"), scale * F.col("fit.scale_factor"), char, word, F.col("at.rise"), mode, F.col("fit.offset"), F.col("at.stroke"), F.col("at.pen")))
    wide = report(per.where("fit.overflow"), "overflow", "info", F.lit(""))
    blocks = per.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_seq", "block"))), lambda x: x["block"]), "\n").alias("block"), F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"),
        F.count("*").alias("lines_changed"), F.sum(F.size(F.filter("segments", lambda x: x["font"] != FALLBACK_NAME))).alias("reused_font"), F.sum(F.size(F.filter("segments", lambda x: x["font"] == FALLBACK_NAME))).alias("fallback_font"))
    gone = pieces.withColumn("silent", edit.silenced(original=F.decode("source", "ISO-8859-1"))).select(*stream, "line_seq", "start", "end", "silent.mode", F.encode("silent.text", "ISO-8859-1").alias("bytes"))
    hidden = report(gone.where("mode = 'invisible'").select(*line).distinct(), "hidden-not-removed", "info", F.lit(""))
    silenced = gone.groupBy(*page).agg(F.count("*").alias("runs_rewritten"), F.count_if(F.col("mode") == "delete").alias("runs_deleted"))
    touched = gone.select(*stream).distinct()
    spliced = edit.splice(streams.join(touched, stream, "left_semi").select(*stream, "content"), gone, stream)
    new = spliced.groupBy(*page).agg(F.map_from_entries(F.collect_list(F.struct("stream_key", "content"))).alias("new"))
    edited = pages.drop("edits").join(new, page, "left").join(blocks, page, "left").join(silenced, page, "left")
    content = F.coalesce(F.try_element_at("new", F.concat(F.lit("page:"), F.col("page_index").cast("string"))), F.col("content"))
    content = F.when(F.col("block").isNull(), F.col("content")).otherwise(wrapped(content, F.coalesce("block", F.lit(""))))
    fonts = F.when(F.size("more") > 0, F.map_concat(F.map_filter("fonts", lambda n, _: ~F.exists("more", lambda m: m["name"] == n)), F.map_from_entries("more"))).otherwise(F.col("fonts"))
    if "forms" in pages.columns:
        was = lambda n, f: F.concat(F.lit("xobj:"), F.when(F.coalesce(f["key"], F.lit("")) != "", f["key"]).otherwise(n))
        edited = edited.withColumn("forms", F.transform_values("forms", lambda n, f: f.withField("content", F.coalesce(F.try_element_at("new", was(n, f)), f["content"]))))
    edited = edited.withColumn("content", content).withColumn("fonts", fonts)
    edited = edited.withColumn("edits", F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])).drop("block", "more", "new", *COUNTERS)
    clash = report(edit.conflicts(gone.drop("line_seq"), stream).withColumn("line_seq", F.lit(None).cast("int")), "conflict", "error", F.lit(""))
    return edited, locked.union(shared).union(no_font).union(swapped).union(lost).union(hidden).union(wide).union(clash)
