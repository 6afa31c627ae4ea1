"""Encodings, code maps, filters, colours and forms with resources of their own."""

import json
import random
import time

import pytest

from quirefold.functions import fonts
from quirefold.functions.cmap import Font
from quirefold.functions.pdfobjects import PdfFile, build_pdf, lzw, name_bytes
from quirefold.functions.trie import Encoder, stand_ins
from quirefold.operators import encode, interpret
from quirefold.sources.typeset import WIDE_FONT


def test_lzw_example_of_the_format():
    assert lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@pytest.mark.parametrize(("encoding", "code", "text"), [("standard", 39, "’"), ("standard", 251, "ß"), ("standard", 65, "A"), ("symbol", 97, "α"), ("symbol", 165, "∞"), ("dingbats", 0x21, "✁"), ("dingbats", 0xAC, "①"), ("dingbats", 0x48, "★"), ("none", 65, ""), ("cp1252", 0x80, "€")])
def test_encodings(encoding, code, text):
    assert fonts.encoded_text(encoding, code) == text


def test_faces():
    assert [fonts.face_of(x) for x in ("Helvetica", "ABCDEF+Times-Bold", "TimesNewRoman", "CourierNew", "Arial-BoldMT")] == ["Helvetica", "Times-Bold", "Times-Roman", "Courier", "Helvetica-Bold"]
    assert [fonts.face_of(x) for x in ("TimesNewRomanPS-BoldItalicMT", "Times-Italic", "Helvetica-BoldOblique", "Courier-Oblique")] == ["Times-BoldItalic", "Times-Italic", "Helvetica-Bold", "Courier"]
    assert [len(t) for t in fonts.OTHER_FACES.values()] == [95] * 5 and (fonts.char_width("A", "Times-Italic"), fonts.char_width("é", "Times-BoldItalic"), fonts.char_width("M", "Times-Italic")) == (611, 444, 833)
    assert (fonts.char_width("A", "Times-Roman"), fonts.char_width("é", "Times-Bold"), fonts.char_width("W", "Helvetica-Bold")) == (722, 444, 944)


def test_embedded_code_map():
    font = Font(json.loads(WIDE_FONT))
    shown = font.glyphs("ż中😀".encode("utf-32-be"))
    assert "".join(g.unicode for g in shown) == "ż中😀" and [g.byte_len for g in shown] == [4, 4, 4] and shown[0].cid == ord("ż")
    program = b"begincmap 2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 begincidrange <20> <7E> 1 endcidrange 1 begincidchar <8001> 500 endcidchar endcmap"
    mixed = Font({"type0": True, "cmap": program.hex(), "cid_widths": [[1, 95, 400], [500, 500, 900]], "default_width": 1000})
    assert [(g.code, g.cid, g.width) for g in mixed.glyphs(b"A\x80\x01")] == [(0x41, 34, 400.0), (0x8001, 500, 900.0)]
    unknown = Font({"type0": True, "cmap_name": "UniJIS-UCS2-H"})
    assert unknown.issues == ["predefined-cmap:UniJIS-UCS2-H"] and unknown.repertoire() == []


def test_repertoire_of_a_subset_needs_widths():
    assert {r[2] for r in Font({"encoding": "cp1252", "subset": True, "widths": {"65": 600, "66": 600}}).repertoire()} == {"A", "B"}


@pytest.mark.parametrize(("space", "parts", "want"), [("tint", [0.25], (0.75,) * 3), ("cmyk", [0, 1, 0, 0.5], (0.5, 0.0, 0.5)), ("unknown", [0.1, 0.2, 0.3], (0.1, 0.2, 0.3)), ("rgb", [2, -1, 0.5], (1.0, 0.0, 0.5)), ("unknown", [1, 2], None)])
def test_colours(space, parts, want):
    assert interpret.rgb(space, parts) == want


def test_colour_spaces_in_the_fold():
    page = interpret.Page({"F1": Font({})}, {}, {"Ink": "tint"})
    page.run(b"BT /F1 9 Tf 1 0 0 rg /Ink cs (a) Tj 0.25 scn (b) Tj /P scn (c) Tj ET", "page:0", interpret.State())
    assert [r["fill"] for r in page.runs] == [[1.0, 0.0, 0.0], [0.75, 0.75, 0.75], None]


def test_forms_with_their_own_resources():
    inner = b"5 0 obj << /Type /XObject /Subtype /Form /Resources << /Font << /F1 7 0 R >> /XObject << /Y 6 0 R >> >> /Length %d >> stream\n%s\nendstream endobj\n"
    own, deep = b"BT /F1 9 Tf (x) Tj ET /Y Do", b"BT /F1 9 Tf (y) Tj ET"
    data = (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R /AcroForm << /SigFlags 3 >> >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 8 0 R >> /XObject << /X 5 0 R >> /ColorSpace << /A /B /B [/ICCBased 9 0 R] /S [/Separation /Gold /DeviceCMYK 1] >> >> /Contents 4 0 R >> endobj\n"
        b"4 0 obj << /Length 30 >> stream\nBT /F1 9 Tf (p) Tj ET /X Do /X Do\nendstream endobj\n" + inner % (len(own), own) + b"6 0 obj << /Subtype /Form /Length %d >> stream\n%s\nendstream endobj\n" % (len(deep), deep)
        + b"7 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Courier >> endobj\n8 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj\n9 0 obj << /N 4 /Length 0 >> stream\n\nendstream endobj\n"
    )
    file = PdfFile.parse(data)
    page = file.pages()[0]
    found, forms = file.resources(page)
    assert set(forms) == {"X", "#6 0 R"} and forms["X"]["key"] == "5 0 R" and file.spaces_of(page) == {"A": "cmyk", "B": "cmyk", "S": "tint"} and file.signed()
    made = {k: interpret.Form(f["content"], interpret._EYE, {n: Font(json.loads(x)) for n, x in f["fonts"].items()} if f["fonts"] else None, f["names"], f["key"]) for k, f in forms.items()}
    folded = interpret.Page({n: Font(json.loads(x)) for n, x in found.items()}, made)
    folded.run(file.page_content(page), "page:0", interpret.State())
    assert [(r["text"], r["stream_key"], r["width_sum"]) for r in folded.runs] == [("p", "page:0", 556.0)] + 2 * [("x", "xobj:5 0 R", 600.0), ("y", "xobj:6 0 R", 600.0)]
    assert folded.uses == 2 * ["xobj:5 0 R", "xobj:6 0 R"]


def test_files_keep_their_fonts():
    spec = json.dumps({"base": "Times Roman", "encoding": "mac_roman", "widths": {"65": 700, "67": 650}})
    file = PdfFile.parse(build_pdf([b"q Q"], fonts=[{"F 1": spec, "W": WIDE_FONT}]))
    found, _ = file.resources(file.pages()[0])
    own, wide = json.loads(found["F 1"]), json.loads(found["W"])
    assert own["base"] == "Times Roman" and own["encoding"] == "mac_roman" and own["widths"]["65"] == 700 and wide["cmap"] and Font(wide).glyphs("中".encode("utf-32-be"))[0].unicode == "中"
    assert name_bytes("A b#") == b"/A#20b#23"


LIGATED = {"type0": True, "to_unicode": b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 5 beginbfchar <0001> <0066> <0002> <0069> <0003> <00660069> <0004> <006600660069> <0005> <0061> endbfchar 1 beginbfrange <0006> <0007> <0061> endbfrange endcmap".hex(), "cid_widths": [[1, 9, 500]], "default_width": 0}


def plainly(font, text):
    """Longest match one position after another: (bytes, width, glyphs, blanks, lost)."""
    best = {}
    for code, n, t, width, rank in font.repertoire():
        if (len(t) == 1 or (len(t) <= 4 and t.isalpha())) and (t not in best or (rank, code) < best[t][0]):
            best[t] = ((rank, code), code.to_bytes(n, "big"), width)
    out, lost, i = [], [], 0
    while i < len(text):
        for n in (4, 3, 2, 1):
            if i + n <= len(text) and text[i : i + n] in best:
                out.append(best[text[i : i + n]])
                i += n
                break
        else:
            forms = [f for f in stand_ins(text[i]) if all(c in best for c in f)]
            lost += [] if forms else [text[i]]
            out += [best[c] for c in forms[0]] if forms else []
            i += 1
    return b"".join(b for _, b, _ in out), pytest.approx(sum(w for *_, w in out)), len(out), sum(b == b" " for _, b, _ in out), lost


@pytest.mark.parametrize("spec", [{"encoding": "cp1252"}, LIGATED, json.loads(WIDE_FONT), {"encoding": "symbol"}, {"type0": True, "cmap_name": "UniJIS-UCS2-H"}])
def test_encoder_against_one_position_after_another(spec):
    font, rng = Font(spec), random.Random(6)
    texts = ["", *["".join(rng.choice(["f", "fi", "ffi", "i", "a", "b", "c", " ", "é", "e\u0301", "ﬁ", "“", "…", "\u2003", "\u200b", "ż", "中", "😀", "Ω", "\n"]) for _ in range(rng.randint(0, 20))) for _ in range(300)]]
    assert Encoder(font).encode(texts) == [plainly(font, t) for t in texts]


def test_hints_take_the_code_of_before():
    own = Encoder(Font(LIGATED))
    assert own.encode(["ab"])[0][0] == b"\0\5\0\7" and own.encode(["ab"], own.hinted(b"\0\6\0\5"))[0][0] == b"\0\6\0\7"
    subset = Encoder(Font({"encoding": "cp1252", "subset": True, "widths": {"65": 600}, "differences": {"200": "A"}}))
    assert subset.hinted(b"\xc8") == {} and subset.encode(["A"])[0][0] == b"A"  # a code without a width isn't in the subset


def test_encoded_rows(spark):
    latin = json.dumps({"base": "Helvetica", "encoding": "cp1252", "differences": {"200": "e"}})
    rows = [(1, latin, "see", b"(s\\310e) Tj"), (2, latin, "see", b"[(s) 4 (e)] TJ"), (3, latin, None, None), (4, latin, "", b"(x) Tj"), (5, None, "ab", None), (6, latin, "e中", None), (6, latin, "e中", None)]
    got = sorted((r.k, bytes(r.bytes), r.n_glyphs, r.unmapped) for r in encode.encoded(spark.createDataFrame(rows, "k int, font string, text string, source binary"), ["k"]).collect())
    assert got == [(1, b"s\xc8\xc8", 3, []), (2, b"see", 3, []), (3, b"", 0, []), (4, b"", 0, []), (5, b"", 0, ["a", "b"]), (6, b"e", 1, ["中"]), (6, b"e", 1, ["中"])]
    assert encode.encoded(spark.createDataFrame([], "k int, font string, text string"), ["k"]).count() == 0


def test_time_follows_the_length():
    own, took = Encoder(Font(LIGATED)), []
    for n in (20_000, 200_000):
        began = time.process_time()
        own.encode(["ffiab" * n])
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.02)


def test_graphics_states_and_property_lists(spark):
    content = b"BT /F1 9 Tf (a) Tj /G1 gs (b) Tj q /G2 gs (c) Tj Q (d) Tj ET /Span /P1 BDC BT (e) Tj ET /Inner BMC BT (f) Tj ET EMC EMC /Span /P2 BDC BT (g) Tj ET EMC"
    data = (
        b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /ExtGState << /G1 << /Font [6 0 R 20] >> /G2 7 0 R /G3 << /LW 2 >> >> /Properties << /P1 << /ActualText (read me) >> /P2 8 0 R >> >> >> endobj\n"
        b"4 0 obj << /Length %d >> stream\n%s\nendstream endobj\n5 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj\n6 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Courier >> endobj\n7 0 obj << /Font [<< >> 30] >> endobj\n8 0 obj << /ActualText <FEFF017C> >> endobj\n"
    ) % (len(content), content)
    from quirefold.sources import pdf

    pages = pdf.pages(spark.createDataFrame([(1, data)], "doc_id long, content binary"))
    got = [(r.text, r.font_name, r.font_size, r.width_sum, r.actual_text) for r in interpret.text_runs(pages).orderBy("run_seq").collect()]
    assert got == [("a", "F1", 9, 556, None), ("b", "gs:G1", 20, 600, None), ("c", "gs:G1", 30, 600, None), ("d", "gs:G1", 20, 600, None), ("e", "gs:G1", 20, 600, "read me"), ("f", "gs:G1", 20, 600, "read me"), ("g", "gs:G1", 20, 600, "ż")]
