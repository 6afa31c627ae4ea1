"""References as tables against walks in plain Python; files updated in place."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions.pdfobjects import PdfFile, build_pdf
from quirefold.functions.pdfupdate import token, updated
from quirefold.operators import encode, graph, interpret, lines
from quirefold.sources import pdf


def walk(edges, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        a = todo.pop()
        for x, b in edges:
            if x == a and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_reachable_against_a_walk(spark):
    rng = random.Random(4)
    graphs = {
        1: ([(k, k + 1) for k in range(120)], [0]),  # a long line
        2: ([(0, 1), (1, 2), (2, 0), (5, 6), (6, 5), (6, 7), (2, 2)], [1]),  # cycles with and without a root
        3: ([(k, j) for k in range(30) for j in (2 * k + 1, 2 * k + 2)], [0, 7]),  # a tree
        4: ([(rng.randrange(60), rng.randrange(60)) for _ in range(70)], [0, 1]),
        5: ([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 3), (9, 4)], [0]),  # a shared node
        6: ([(1, 2)], [4]),
    }
    edges = [(g, a, b) for g, (e, _) in graphs.items() for a, b in e] + [(1, None, 3)]
    roots = [(g, n) for g, (_, r) in graphs.items() for n in r]
    got = graph.reachable(spark.createDataFrame(edges, "doc int, from long, to long"), spark.createDataFrame(roots, "doc int, node long"), ["doc"])
    want = {(g, n) for g, (e, r) in graphs.items() for n in walk(e, r)}
    rows = [(r.doc, r.node) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_chains_end_or_never_do(spark):
    pointers = [(1, k, k + 1) for k in range(50)] + [(2, 1, 2), (2, 2, 1), (2, 3, 1), (3, 1, 9)]
    got = {(r.doc, r["from"]): r.last for r in graph.resolved(spark.createDataFrame(pointers, "doc int, from long, to long"), ["doc"]).collect()}
    assert got == {**{(1, k): 50 for k in range(50)}, (2, 1): None, (2, 2): None, (2, 3): None, (3, 1): 9}
    assert graph.resolved(spark.createDataFrame([], "doc int, from long, to long"), ["doc"]).count() == 0


IMAGE = bytes(range(256)) * 3


def shop(packed: bool = False) -> bytes:
    """Three pages: two share a content stream, one has a list of streams as an object, an image, a form, a link and an outline."""
    form = b"BT /F2 9 Tf 10 10 Td (Inside form) Tj ET"
    stream = lambda keys, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (keys, len(data), data)
    bodies = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 12 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 /Resources 6 0 R /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R] >>", 5: b"<< /Type /Page /Parent 2 0 R /Contents 8 0 R /Annots [13 0 R] >>",
        6: b"<< /Font << /F1 14 0 R >> /XObject << /Im 10 0 R /Fm 11 0 R >> >>", 7: stream(b"", b"BT /F1 12 Tf 72 700 Td (Shared page) Tj ET"), 8: b"[9 0 R 15 0 R]",
        9: stream(b"", b"q 10 0 0 10 0 0 cm /Im Do Q BT /F1 12 Tf 72 700 Td (First part) Tj ET"), 10: stream(b"/Type /XObject /Subtype /Image /Width 16 /Height 16 /ColorSpace /DeviceRGB /BitsPerComponent 8", IMAGE),
        11: stream(b"/Type /XObject /Subtype /Form /BBox [0 0 99 99] /Resources << /Font << /F2 16 0 R >> >>", form), 12: b"<< /Type /Outlines /Title (Contents \\(old\\)) >>", 13: b"<< /Type /Annot /Subtype /Link /Rect [0 0 1 1] /Dest [3 0 R /Fit] >>",
        14: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 15: stream(b"", b"BT /F1 12 Tf 72 680 Td (Second part) Tj ET /Fm Do"), 16: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>",
    }
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, body in bodies.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if packed:
        import struct

        at[17] = len(out)
        table = b"".join(struct.pack(">BQH", 1, at[n], 0) for n in range(1, 18))
        return bytes(out) + b"17 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (stream(b"/Type /XRef /Size 18 /Index [1 17] /W [1 8 2] /Root 1 0 R /Info 12 0 R", table), at[17])
    table = len(out)
    out += b"xref\n0 17\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, 17))
    return bytes(out) + b"trailer\n<< /Size 17 /Root 1 0 R /ID [<01> <02>] >>\nstartxref\n%d\n%%%%EOF" % table


def last_table(data: bytes) -> dict[int, tuple[str, int]]:
    """What the last cross-reference says: number -> (n or f, offset)."""
    at = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    rows, out, k = data[at:].split(b"trailer")[0].split(b"\n")[1:], {}, 0
    while k < len(rows) and len(rows[k].split()) == 2:
        first, n = map(int, rows[k].split())
        for i in range(n):
            offset, _, kind = rows[k + 1 + i].split()
            out[first + i] = (kind.decode(), int(offset))
        k += 1 + n
    return out


def test_an_update_leaves_the_old_bytes():
    data = shop()
    same, none = updated(data, {0: (b"BT /F1 12 Tf 72 700 Td (Shared page) Tj ET", {"F1": PdfFile.parse(data).font_spec(PdfFile.parse(data).objects[14])})})
    assert same == data and none == []
    new, warnings = updated(data, {2: (b"BT /F9 9 Tf (new) Tj ET", {"F9": json.dumps({"base": "Times Roman", "encoding": "cp1252"})}), 7: (b"", {})}, {"11 0 R": b"q Q", "3 0 R": b""}, (8, 9, 15, 7))
    assert new.startswith(data) and warnings == [("page-write", "page 8"), ("xobject-write", "3 0 R")]
    file, table = PdfFile.parse(new), last_table(new)
    pages = file.pages()
    assert [file.page_content(p) for p in pages] == [b"BT /F1 12 Tf 72 700 Td (Shared page) Tj ET"] * 2 + [b"BT /F9 9 Tf (new) Tj ET"]
    assert set(file.fonts_of(pages[2])) == {"F1", "F9"} and set(file.fonts_of(pages[0])) == {"F1"}  # the shared dictionary is copied
    assert file.content(file.objects[10]) == IMAGE and file.content(file.objects[11]) == b"q Q" and file.objects[11].keys[b"BBox"] and pages[2][b"Annots"]
    assert {n for n, (kind, _) in table.items() if kind == "f"} == {8, 9, 15}  # 7 is still shown, whoever says that it isn't
    for n, (kind, offset) in table.items():
        assert kind == "f" or new[offset:].startswith(b"%d 0 obj" % n)
    assert b"/Prev %d" % int(re.findall(rb"startxref\s+(\d+)", data)[-1]) in new[len(data) :] and b"/ID [<01> <02>]" in new[len(data) :]
    again, _ = updated(new, {0: (b"(third)", {})})
    assert again.startswith(new) and PdfFile.parse(again).page_content(PdfFile.parse(again).pages()[0]) == b"(third)"


def test_updates_of_other_files():
    new, _ = updated(shop(True), {0: (b"q", {})})
    file = PdfFile.parse(new)
    assert file.page_content(file.pages()[0]) == b"q" and b"/Type /XRef" in new[len(shop(True)) :] and b"trailer" not in new and b"/Info 12 0 R" in new[len(shop(True)) :]
    broken = shop().split(b"xref")[0]  # cut off: no cross-reference to go on from
    new, _ = updated(broken, {0: (b"q", {})})
    assert b"/Prev" not in new and {n for n, (kind, at) in last_table(new).items() if new[at:].startswith(b"%d 0 obj" % n)} >= set(range(1, 17))


def test_tokens():
    from quirefold.functions.lexer import Lexer

    value = Lexer(b"<< /A#20b [1 -2.5 true null (x\\)y) <00ff> /N 3 0 R] /D << >> >>", refs=True).value()[1]
    assert Lexer(token(value), refs=True).value()[1] == value


def test_contents_that_nothing_uses(spark):
    found = spark.createDataFrame([(1, shop()), (2, shop()), (3, b"no file")], "doc_id long, content binary")
    gone = lambda *pages: {(r.doc_id, r.to) for r in pdf.unused_contents(found, spark.createDataFrame(list(pages), "doc_id long, page_index int")).collect()}
    assert gone((1, 0)) == set() and gone((1, 0), (1, 1)) == {(1, 7)} and gone((1, 2), (2, 0)) == {(1, 8), (1, 9), (1, 15)}


def test_edited_files_keep_what_was_not_edited(spark):
    found = spark.createDataFrame([(1, shop()), (2, build_pdf([b"BT /F1 9 Tf (alone) Tj ET"]))], "doc_id long, content binary")
    pages = pdf.pages(found)
    pages = spark.createDataFrame(pages.collect(), pages.schema)
    runs = interpret.text_runs(pages)
    runs = spark.createDataFrame(runs.collect(), runs.schema)
    grouped = lines.group_lines(runs)
    grouped = spark.createDataFrame(grouped.collect(), grouped.schema)
    edits = [(1, r.line_seq, r.text.replace("part", "piece").replace("Inside", "Within"), "keep", "left") for r in grouped.where("doc_id = 1").collect() if r.page_index == 2]
    edited, report = encode.apply_edits(pages, runs, grouped, spark.createDataFrame(edits, "doc_id long, line_seq int, new_text string, overflow string, anchor string"))
    out = {r.doc_id: r for r in pdf.patched(found, edited.where("doc_id = 1 and page_index = 2")).collect()}
    new = bytes(out[1].content)
    assert new.startswith(shop()) and bytes(out[2].content) == bytes(found.where("doc_id = 2").collect()[0].content) and out[1].warnings == []
    file = PdfFile.parse(new)
    assert file.content(file.objects[10]) == IMAGE and file.pages()[2][b"Annots"] and b"Inside" not in file.content(file.objects[11])
    assert {n for n, (kind, _) in last_table(new).items() if kind == "f"} == {8, 9, 15}
    again = lines.group_lines(interpret.text_runs(pdf.pages(spark.createDataFrame([(1, new)], "doc_id long, content binary")))).where("page_index = 2 and text != ''").orderBy("line_seq").collect()
    assert [r.text for r in again] == ["First piece", "Second piece", "Within form"]
    assert {r.code for r in report.collect()} <= {"overflow"}


def test_files_are_there_when_the_job_has_committed(spark, tmp_path):
    rows = spark.createDataFrame([(k, b"%d" % k) for k in range(5)], "doc_id long, content binary").repartition(3)
    folder = pdf.save(rows, str(tmp_path))
    names = sorted(f for _, _, names in os.walk(folder) for f in names)
    shown = lambda: [d for d in os.listdir(tmp_path) if not d.startswith("_")]
    assert names == [f"{k}-edited.pdf" for k in range(5)] and os.listdir(tmp_path) == [os.path.basename(folder)]
    bad = rows.withColumn("content", F.when(F.col("doc_id") < 4, F.col("content")).otherwise(F.raise_error(F.lit("stop")).cast("binary")))
    with pytest.raises(Exception, match="stop"):
        pdf.save(bad, str(tmp_path))
    assert shown() == [os.path.basename(folder)]
