"""Lexer, character maps, the fold, line grouping and edits on literal cases and properties."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quirefold.functions.cmap import Font, parse_cmap, utf16
from quirefold.functions.lexer import MAX_OPERANDS, Name, number, operations
from quirefold.operators import edit, encode, interpret, lines, report, session
from quirefold.sources.typeset import typeset

FONT = json.dumps({"base": "Helvetica"})


def ops(data: bytes):
    return [(o.op, o.operands) for o in operations(data)]


def test_tokens_and_spans():
    data = b"q 1 0 0 1 72.5 -.5 cm % note\n/F1 12 Tf (a) Tj Q"
    found = list(operations(data))
    assert [o.op for o in found] == ["q", "cm", "Tf", "Tj", "Q"] and found[1].operands == [1, 0, 0, 1, 72.5, -0.5]
    assert data[found[3].start : found[3].end] == b"(a) Tj" and data[found[3].op_start : found[3].end] == b"Tj"
    assert found[2].operands == [Name(b"F1"), 12.0]


@pytest.mark.parametrize(
    ("source", "value"),
    [(rb"(a(b)c)", b"a(b)c"), (rb"(\(\)\\)", b"()\\"), (rb"(\101\7\400)", b"A\x07\x00"), (b"(a\\\nb)", b"ab"), (b"(a\r\nb\rc)", b"a\nb\nc"), (rb"(\q\n)", b"q\n"), (b"<48 65x6C6>", b"Hel\x60"), (b"(open", b"open")],
)
def test_strings(source, value):
    assert ops(source + (b"" if source == b"(open" else b" Tj")) == ([] if source == b"(open" else [("Tj", [value])])


@pytest.mark.parametrize(("token", "value"), [(b"--5", -5.0), (b"5-3", 5.0), (b".5", 0.5), (b"4.", 4.0), (b"1e2", 100.0), (b"-", None), (b"+7", 7.0)])
def test_numbers(token, value):
    assert number(token) == value


def test_arrays_dictionaries_names():
    assert ops(b"[(a) -120 (b)] TJ") == [("TJ", [[b"a", -120.0, b"b"]])]
    assert ops(b"/A#20B <</K [1 2] /L true>> BDC") == [("BDC", [Name(b"A B"), {b"K": [1.0, 2.0], b"L": True}])]
    assert ops(b"[1 2 Tj") == [("Tj", [[1.0, 2.0]])]


def test_hostile_input_ends():
    assert [o for o, _ in ops(b")" * 50_000 + b"]>>}" * 4_000 + b" q")] == ["q"]
    assert ops(b"[" * 5_000 + b"]" * 5_000 + b" q")[-1][0] == "q"
    assert len(ops(b"1 " * 8_000 + b"w")[0][1]) == 8_000 <= MAX_OPERANDS


def test_inline_images():
    raw = bytes(range(64)).replace(b"E", b"e")[:60] + b" EI "
    data = b"BI /W 8 /H 8 /BPC 8 /CS /G ID " + raw + b"\nEI q (x) Tj"
    assert [o for o, _ in ops(data)] == ["EI", "q", "Tj"]
    assert [o for o, _ in ops(b"BI /W 1 /F /Fl ID abcEIx\nEI Q")] == ["EI", "Q"]
    for keys, size in ((b"/W 4 /H 2", 8), (b"/W 4 /H 2 /BPC 4", 4), (b"/W 9 /H 2 /IM true /BPC 8", 4), (b"/W 2 /H 2 /CS /RGB", 12), (b"/W 4 /H 2 /F []", 8)):
        raw = (b"x EI y EI z EI ")[:size].ljust(size, b".")  # holds what looks like the end
        assert [o for o, _ in ops(b"BI " + keys + b" ID " + raw + b"EI Q")] == ["EI", "Q"], keys
    assert [o for o, _ in ops(b"BI /W 2 /CS /Own ID ab EI/F1 9 Tf")] == ["EI", "Tf"] and [o for o, _ in ops(b"BI /F /Fl ID EI Q")] == ["EI", "Q"]


def test_character_maps():
    m = parse_cmap(b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0041> <02> <00660066> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange")
    assert m.uni[1, 1] == "A" and m.uni[1, 2] == "ff" and [m.uni[1, k] for k in (16, 17, 18, 32, 33)] == list("abcxy")
    two = parse_cmap(b"2 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 1 begincidrange <8000> <8005> 40 endcidrange")
    assert two.decode(b"\x41\x80\x01\x42") == [(0x41, 1), (0x8001, 2), (0x42, 1)] and two.cids[2, 0x8003] == 43
    assert utf16(b"\xd8\x3d\xde\x00") == "\U0001f600" and utf16(b"\x00A\x42") == "AB"


def test_fonts():
    plain = Font({"base": "Helvetica"})
    assert [g.width for g in plain.glyphs(b"A W")] == [667, 278, 944] and plain.space_width == 278
    assert [g.width for g in Font({"base": "Courier"}).glyphs(b"iW")] == [600, 600]
    wide = Font({"type0": True, "cid_widths": [[1, 3, 500], [2, 2, 700]], "default_width": 900})
    assert [(g.cid, g.width) for g in wide.glyphs(b"\x00\x01\x00\x02\x00\x09")] == [(1, 500), (2, 700), (9, 900)]


def pages(spark, *contents: bytes, **more):
    rows = [(k, 0, c, {"F1": FONT}) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "doc_id long, page_index int, content binary, fonts map<string,string>")


def runs(content: bytes, forms=None):
    page = interpret.Page({"F1": Font({"base": "Helvetica"})}, forms or {})
    page.run(content, "page:0", interpret.State())
    return page.runs


def test_fold():
    r = runs(b"BT /F1 10 Tf 100 700 Td (Hello) Tj ET")[0]
    assert (r["x"], r["y"], r["text"], r["effective_size"]) == (100, 700, "Hello", 10) and math.isclose(r["advance"], 22.78)
    r = runs(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 Tc 50 Tz 1 0 0 1 3 4 Tm (A) Tj ET Q")[0]
    assert (r["x"], r["y"], r["effective_size"]) == (16, 28, 20) and math.isclose(r["advance"], (6.67 + 5) * 0.5)
    assert [x["text"] for x in runs(b"BT /F1 10 Tf [(To) -300 (tal) 20 (s) -200 ( x)] TJ ET")] == ["To tals x"]
    assert [x["text"] for x in runs(b"Q Q BT /F1 1 Tf (a) Tj ET (outside) Tj")] == ["a"]
    a, b, c = runs(b"BT /F1 10 Tf 14 TL (a) ' (b) ' 3 2 (c d) \" ET")
    assert [x["y"] for x in (a, b, c)] == [-14, -28, -42] and (c["word_spacing"], c["char_spacing"]) == (3, 2)
    assert runs(b"BT /F1 9 Tf [-500 200] TJ ET") == []
    assert [r["safe_delete"] for r in runs(b"BT /F1 9 Tf (a) Tj (b) Tj 0 -9 Td (c) Tj ET BT (d) Tj ET")] == [False, True, True, False]
    assert runs(b"0.2 g BT /F1 9 Tf (a) Tj ET")[0]["fill"] == [0.2] * 3 and runs(b"1 0 0 .5 k BT /F1 9 Tf (a) Tj ET")[0]["fill"] == [0, 0.5, 0.5]
    assert runs(b"/Span <</ActualText (x)>> BDC BT /F1 9 Tf (a) Tj ET EMC")[0]["actual_text"] == "x"


def test_forms():
    forms = {"X": (b"BT /F1 10 Tf 1 0 0 1 5 6 Tm (in) Tj ET /X Do", (2.0, 0.0, 0.0, 2.0, 7.0, 8.0))}
    r = runs(b"q 1 0 0 1 100 0 cm /X Do Q", forms)
    assert len(r) == 1 and (r[0]["x"], r[0]["y"], r[0]["stream_key"]) == (117, 20, "xobj:X")


def test_lines(spark):
    content = b"BT /F1 12 Tf 72 700 Td (Left) Tj 26 0 Td (and) Tj 300 0 Td (far) Tj ET BT /F1 12 Tf 72 680 Td (same) Tj 0 0 Td (same) Tj ET BT 3 Tr /F1 12 Tf 72 660 Td (ghost) Tj ET"
    found = lines.group_lines(interpret.text_runs(pages(spark, content, b"", b"BT (no font) Tj"))).orderBy("doc_id", "line_seq").collect()
    assert [(r.doc_id, r.text, r.n_runs, r.blockers) for r in found] == [(0, "Left and", 2, []), (0, "far", 1, []), (0, "same", 1, []), (0, "same", 1, []), (0, "ghost", 1, ["invisible"]), (2, "", 1, ["no-unicode"])]


TEXT = st.text("ab (), é", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), TEXT)
def test_distribution_reassembles(parts, new):
    texts, owner = edit.spread(parts, new)
    assert "".join(texts) == new and len(texts) == len(parts) and (owner == -1) == ("".join(parts) == new)


def test_distribution_owner():
    assert edit.spread(["Hello ", "big ", "world"], "Hello big blue world") == (["Hello ", "big ", "blue world"], 2) or edit.spread(["Hello ", "big ", "world"], "Hello big blue world")[0] == ["Hello ", "big blue ", "world"]
    assert edit.spread(["one ", "two"], "one ten") == (["one ", "ten"], 1) and edit.spread(["ab"], "ab") == (["ab"], -1)


def test_silencing_keeps_the_other_runs(spark):
    """Each operator in turn is silenced in the bytes; every other run stays where it was."""
    content = b"q 1.5 0 0 1.5 3 4 cm BT /F1 12 Tf 2 Tc 1 Tw 14 TL 72 700 Td (a b) Tj [(c) -250 (d)] TJ (e) ' (f) Tj 5 1 (g h) \" (i) Tj 0 -20 Td (j) Tj ET Q BT /F1 0 Tf (k) Tj ET"
    before = interpret.text_runs(pages(spark, content)).collect()
    for k, gone in enumerate(before):
        one = interpret.text_runs(pages(spark, content)).where(f"run_seq = {k}")
        original = spark.createDataFrame([(0, 0, content[gone.start : gone.end])], "doc_id long, page_index int, bytes binary")
        reps = one.select("doc_id", "page_index", "start", "end", edit.silenced()["text"].alias("t")).join(original, ["doc_id", "page_index"])
        text = reps.collect()[0].t
        if gone.font_size == 0:
            text = text.replace("  0 Tr", f" {content[gone.start : gone.end].decode()} 0 Tr")
        spliced = content[: gone.start] + text.encode() + content[gone.end :]
        after = [r for r in runs(spliced) if r["text"] not in ("",)]
        left = {r.text: (r.x, r.y) for r in before if r.run_seq != k}
        got = {r["text"]: (r["x"], r["y"]) for r in after}
        for t, at in left.items():
            assert all(math.isclose(p, q, abs_tol=1e-4) for p, q in zip(at, got[t])), (k, t)


def test_splice(spark):
    streams = spark.createDataFrame([(1, b"0123456789"), (2, b"abc"), (3, b"xyz")], "id long, content binary")
    reps = spark.createDataFrame([(1, 2, 4, b"AA"), (1, 2, 4, b"AA"), (1, 4, 4, b"-"), (1, 8, 10, b""), (2, 0, 2, b"x"), (2, 1, 3, b"y")], "id long, start long, end long, bytes binary")
    assert {r.id: bytes(r.content) for r in edit.splice(streams, reps, ["id"]).collect()} == {1: b"01AA-4567", 2: b"abc", 3: b"xyz"}
    assert [r.start for r in edit.conflicts(reps.distinct(), ["id"]).collect()] == [1]
    more = reps.union(spark.createDataFrame([(3, 2, 4, b"?"), (3, 1, 0, b"?"), (4, 0, 0, b"?"), (1, 10, 10, b"end")], reps.schema))
    assert sorted(map(tuple, edit.refused(streams, more, ["id"]).collect())) == [(2, 1, 3, "overlap"), (3, 1, 0, "outside"), (3, 2, 4, "outside"), (4, 0, 0, "outside")]


def test_sessions(spark):
    rows = [(1, 0, "l1", 0), (1, 1, "l1", 400_000), (1, 2, "l1", 1_000_000), (1, 3, "l2", 1_100_000), (2, 4, "l1", 0)]
    found = session.coalesced(spark.createDataFrame(rows, "s long, e long, line string, t long"), "s", "line", "t", ["e"]).orderBy("e").collect()
    assert [r.burst for r in found] == [1, 1, 2, 3, 1]
    acts = [(1, k, a, v) for k, (a, v) in enumerate([("edit", "a"), ("edit", "b"), ("undo", ""), ("undo", ""), ("undo", ""), ("redo", ""), ("edit", "c"), ("redo", "")])]
    out = session.replay(spark.createDataFrame(acts, "s long, k long, a string, v string"), "s", "k", "a", "v").orderBy("seq").collect()
    assert [(r.present, r.undo_depth, r.redo_depth) for r in out] == [("a", 1, 0), ("b", 2, 0), ("a", 1, 1), (None, 0, 2), (None, 0, 2), ("a", 1, 1), ("c", 2, 0), ("c", 2, 0)]


FORMED = "doc_id long, page_index int, content binary, fonts map<string,string>, forms map<string,struct<content:binary,matrix:array<double>,fonts:map<string,string>,names:map<string,string>,key:string>>"


def edited_pages(spark, content: bytes, forms: dict):
    """(the page after every line got a mark behind it, the codes of the report by line, its lines before)."""
    page = spark.createDataFrame([(1, 0, content, {"F1": FONT}, forms)], FORMED)
    found = spark.createDataFrame(interpret.text_runs(page).collect(), interpret.text_runs(page).schema)
    grouped = spark.createDataFrame(lines.group_lines(found).collect(), lines.group_lines(found).schema)
    edits = grouped.select("doc_id", "line_seq", F.concat("text", F.lit("!")).alias("new_text"), F.lit("keep").alias("overflow"), F.lit("left").alias("anchor"))
    edited, report = encode.apply_edits(page, found, grouped, edits)
    return edited, {(r.line_seq, r.code) for r in report.collect()}, grouped


def test_edits_inside_forms(spark):
    """The form's own operator is silenced; the text stands where it was, in the form's font, and the page's line stays."""
    inner = b"BT /F1 9 Tf 10 10 Td (Inside form) Tj ET"
    own = json.dumps({"base": "Courier"})
    forms = {"X": {"content": inner, "matrix": [2.0, 0.0, 0.0, 2.0, 5.0, 7.0], "fonts": {"F1": own}, "names": {}, "key": "5 0 R"}}
    edited, codes, before = edited_pages(spark, b"BT /F1 9 Tf 72 700 Td (Page line) Tj ET /X Do", forms)
    after = edited.collect()[0]
    assert b"Inside" not in bytes(after.forms["X"].content) and own in after.fonts.values() and (2, "shared-xobject") not in codes
    again = lines.group_lines(interpret.text_runs(edited)).where("text != ''").orderBy("line_seq").collect()
    was = before.orderBy("line_seq").collect()
    assert [r.text for r in again] == ["Page line!", "Inside form!"] and [(r.x, r.y, r.size) for r in again] == [(r.x, r.y, r.size) for r in was]
    assert (again[1].x, again[1].y, again[1].size) == (25, 27, 18) and math.isclose(again[1].width, 12 * 0.6 * 18)


def test_forms_that_are_shown_twice_keep_their_text(spark):
    inner = b"BT /F1 9 Tf 10 10 Td (Inside form) Tj ET"
    forms = {"X": {"content": inner, "matrix": None, "fonts": None, "names": None, "key": "5 0 R"}, "Y": {"content": inner, "matrix": None, "fonts": None, "names": None, "key": ""}}
    edited, codes, _ = edited_pages(spark, b"BT /F1 9 Tf 72 700 Td (Page line) Tj ET /X Do 1 0 0 1 0 50 cm /X Do 1 0 0 1 0 50 cm /Y Do", forms)
    after = edited.collect()[0]
    assert {bytes(f.content) for f in after.forms.values()} == {inner} and b"(Page line)" not in bytes(after.content)
    assert {c for c in codes if c[1] == "shared-xobject"} == {(2, "shared-xobject"), (3, "shared-xobject"), (4, "shared-xobject")}


def test_warnings_of_documents(spark):
    good, form = b"BT /F1 9 Tf (a) Tj ET", {"X": {"content": b"BT /F1 9 Tf (in) Tj ET", "matrix": None, "fonts": None, "names": None, "key": "5 0 R"}}
    rows = [(1, 0, good, None, [], True), (2, 0, b"q Q", None, [], False), (3, 0, b"BT 3 Tr /F1 9 Tf (ghost) Tj ET", None, [], False), (4, 0, b"/X Do", None, [], False), (4, 1, b"/X Do", None, [], False), (5, 0, b"/X Do /X Do BT 7 Tr /F1 9 Tf (clip) Tj ET", None, ["content-decode"], False), (6, None, None, "encrypted", None, None)]
    found = spark.createDataFrame([(d, p, c, {"F1": FONT}, form, w, i, s) for d, p, c, w, i, s in rows], FORMED + ", warning string, issues array<string>, signed boolean")
    texts = interpret.text_runs(found.where("warning IS NULL"))
    grouped = lines.group_lines(texts, report.repeated_streams(texts))
    got = {(r.doc_id, r.page_index, r.code, r.level) for r in report.load_warnings(found, texts, grouped).collect()}
    assert got == {(1, None, "signed", "warn"), (2, None, "no-text", "error"), (3, None, "no-editable-text", "error"), (4, None, "shared-xobject", "warn"), (4, None, "no-editable-text", "error"), (5, None, "shared-xobject", "warn"), (5, 0, "text-clip", "info"), (5, None, "no-editable-text", "error"), (5, 0, "content-decode", "warn"), (6, None, "encrypted", "error")}


def test_warnings_and_counters_of_edits(spark):
    content = b"BT /F1 9 Tf 72 700 Td (one) Tj 0 -20 Td (two) Tj ET BT 3 Tr /F1 9 Tf 72 500 Td (ghost) Tj ET BT 0 Tr /F1 0 Tf 72 400 Td (flat) Tj ET"
    page = spark.createDataFrame([(1, 0, content, {"F1": json.dumps({"base": "Helvetica", "encoding": "cp1252", "subset": True, "widths": {str(ord(c)): 500 for c in "onetwflag"}})})], "doc_id long, page_index int, content binary, fonts map<string,string>")
    found = spark.createDataFrame(interpret.text_runs(page).collect(), interpret.text_runs(page).schema)
    grouped = spark.createDataFrame(lines.group_lines(found).collect(), lines.group_lines(found).schema)
    new = {"one": "ten", "two": "two ß中", "flat": "fat", "ghost": "host"}
    edits = spark.createDataFrame([(1, r.line_seq, new[r.text], "keep", "left") for r in grouped.collect()], "doc_id long, line_seq int, new_text string, overflow string, anchor string")
    edited, told = encode.apply_edits(page, found, grouped, edits)
    seen = Observation("export")
    stats = encode.observed(edited, seen).collect()[0].edits
    assert seen.get == stats.asDict() == {"lines_changed": 3, "runs_rewritten": 3, "runs_deleted": 2, "reused_font": 2, "fallback_font": 1}
    codes = {(r.line_seq, r.code, r.detail) for r in told.collect() if r.code != "overflow"}
    assert codes == {(3, "locked-line", "invisible"), (2, "font-substituted", " ß"), (2, "unrenderable", "中"), (4, "hidden-not-removed", "")}
    bare, told = encode.apply_edits(page, found, grouped, edits, fallback=None)
    assert (2, "no-font") in {(r.line_seq, r.code) for r in told.collect()} and b"QfFallback" not in bytes(bare.collect()[0].content)
    assert bytes(encode.apply_edits(page, found, grouped, edits, fallback=json.dumps({"base": "Courier", "encoding": "cp1252"}))[0].collect()[0].content).count(b"QfFallback") == 1


def test_characters_of_all_planes_are_typeset(spark):
    text = "plain\nż中😀\n𠀀 and 𪛖 \U000e0041\U0010fffd\né"
    page = typeset(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    got = lines.group_lines(interpret.text_runs(page, lines.NEEDED)).orderBy("line_seq").collect()
    assert [r.text for r in got] == text.split("\n")


def test_outlined_text_keeps_its_pen(spark):
    content = b"1 0 0 RG 3 w BT 2 Tr /F1 9 Tf 72 700 Td (one) Tj ET 0 g BT 0 Tr /F1 9 Tf 72 600 Td (two) Tj ET"
    assert [(r["stroke"], r["line_width"]) for r in runs(content)] == [([1.0, 0.0, 0.0], 3.0)] * 2
    edited, _, _ = edited_pages(spark, content, {})
    new = bytes(edited.collect()[0].content)
    first, second = new.split(b"Q\n", 1)[1].split(b"ET\nQ", 1)
    assert b"2 Tr\n1 0 0 RG\n3 w\n" in first and b" RG" not in second and b" w\n" not in second
