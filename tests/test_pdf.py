"""Files: reading, refusing, page geometry, writing."""

import zlib

from quirefold.functions.pdfobjects import PdfFile, build_pdf, glyph_text, unfilter
from quirefold.operators import interpret, lines
from quirefold.sources import pdf


def test_glyph_names():
    assert [glyph_text(n) for n in ("A", "eacute", "uni00E9", "u1F600", "f_i", "a.alt", "quoteright", "nonsense")] == ["A", "é", "é", "\U0001f600", "fi", "a", "’", ""]


def test_glyph_names_that_are_put_together():
    names = "Aacute Acircumflexacute scommaaccent Gcommaaccent ohungarumlaut Zdotaccent aeacute onesuperior foursuperior twoinferior afii10017 afii10023 afii10024 afii10049 afii10071 afii10097 alpha Lambda sigmafinal Alphatonos Omega Omegagreek kahiragana tusmallkatakana infinity ff uni00e9 u1f600 A_nonsense g12 .notdef Qacute"
    want = [*"ÁẤșĢőŻǽ¹⁴₂АЁЖЯёя", *"αΛςΆ\u2126Ωかッ∞", "ff", "é", "😀", "", "", "", ""]
    assert [glyph_text(n) for n in names.split()] == want


def test_filters():
    assert unfilter(b"AHx", b"48 656c6C>") == b"Hell" and unfilter(b"RL", bytes([2, 65, 66, 67, 254, 90, 128])) == b"ABCZZZ" and unfilter(b"Fl", zlib.compress(b"x")) == b"x"


def test_object_streams_and_updates():
    inner = b"1 0 5 38 " + b"<< /Type /Catalog /Pages 5 0 R >>".ljust(38) + b"<< /Type /Pages /Kids [6 0 R] >>"
    data = b"%PDF-1.7\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Length 999 >> stream\n" + inner + b"\nendstream endobj 6 0 obj << /Contents [7 0 R 8 0 R] /Rotate 90 >> endobj 7 0 obj << /Length 2 >> stream\nq \nendstream endobj 8 0 obj << >> stream\nQ\nendstream endobj 7 0 obj << /Length 1 >> stream\nW\nendstream endobj"
    file = PdfFile.parse(data)
    assert [file.page_content(p) for p in file.pages()] == [b"W\nQ"]


def test_round_trip_and_refusals(spark, tmp_path):
    content = b"BT /F1 12 Tf 72 700 Td (Hello) Tj ET"
    rows = [(1, build_pdf([content, b"", content.replace(b"Hello", b"Again")])), (2, b"no pdf"), (3, b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>"), (4, b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj"), (5, None)]
    found = pdf.pages(spark.createDataFrame(rows, "doc_id long, content binary"))
    assert {(r.doc_id, r.warning) for r in found.collect()} == {(1, None), (2, "parse"), (3, "encrypted"), (4, "empty"), (5, "parse")}
    assert [(r.page_index, r.text) for r in lines.group_lines(interpret.text_runs(found.where("warning is null"))).orderBy("line_seq").collect()] == [(0, "Hello"), (2, "Again")]
    pdf.save(pdf.documents(found.where("warning is null")), str(tmp_path))
    again = pdf.pages(pdf.files(spark, str(tmp_path)))
    assert [bytes(r.content) for r in again.orderBy("page_index").collect()] == [content, b"", content.replace(b"Hello", b"Again")]


def test_geometry(spark):
    rows = [(1, 0, [0.0, 0.0, 612.0, 792.0], [50.0, 60.0, 562.0, 742.0], 90.0), (2, 0, [20.0, 20.0, 632.0, 812.0], None, None), (3, 0, None, [700.0, 0.0, 800.0, 5.0], -90.0), (4, 0, None, None, 44.0)]
    got = pdf.page_geometry(spark.createDataFrame(rows, "doc_id long, page_index int, media array<double>, crop array<double>, rotate double")).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == [(512, 682, 90, 50, 60, 682, 512), (612, 792, 0, 20, 20, 612, 792), (612, 792, 270, 0, 0, 792, 612), (612, 792, 0, 0, 0, 612, 792)]
