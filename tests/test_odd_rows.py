"""Queries against their SQL on rows that the given tables lack."""

import json

import duckdb

from quirefold.functions.cmap import Font
from quirefold.functions.trie import Encoder
from quirefold.operators import encode, interpret, lines
from quirefold.plans.queries import QUERIES, SQL
from quirefold.sources import pdf
from quirefold.sources.typeset import WIDE_FONT


def differing(spark, folder, name, table, schema, rows):
    """Rows (of SQL, of the query) that the other side lacks, with ``rows`` as the only table."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{table}.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    key = lambda r: tuple((x is None, x) for x in r)
    got, rows = sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*names).collect()), key=key), sorted(want.fetchall(), key=key)
    return [r for r in rows if r not in got], [r for r in got if r not in rows], len(rows) - len(got)


def test_excess_is_measured_by_its_decimal(spark, tmp_path):
    rows = [(k, n, p) for k, p in enumerate((50050.0, 50050.01, 20000.0, 20020.0, 33366.67, 104999.91, None)) for n in (1, 2, None)]
    assert differing(spark, tmp_path, "fit_policy", "lineitem", "l_orderkey long, l_linenumber int, l_extendedprice double", rows) == ([], [], 0)


EMPTY = [(1, ""), (2, "\n"), (3, "a\n"), (4, "\na"), (5, "a\n\n"), (6, "a"), (7, " "), (8, None), (9, "日\n"), (10, "a\n日本\n\n")]


def test_splice_leaves_nothing_of_an_empty_page(spark, tmp_path):
    assert differing(spark, tmp_path, "replace_splice", "documents", "doc_id long, text string", EMPTY) == ([], [], 0)


def test_last_operator_moves_also_if_it_shows_nothing(spark, tmp_path):
    assert differing(spark, tmp_path, "safe_neutralise", "documents", "doc_id long, text string", EMPTY) == ([], [], 0)


def test_rows_of_equal_hints_are_encoded_together(monkeypatch):
    own = Encoder(Font({"base": "Helvetica", "encoding": "cp1252", "differences": {"200": "e", "201": "n"}}))
    monkeypatch.setattr(own.font, "glyphs", None)  # hints come from the different codes, not from every glyph
    before = [b"(x\xc8) Tj", b"(\xc8\xc9) Tj", b"(\xc9\xc8) Tj", None, b"(e) Tj"] * 40
    text, calls, encode_all = ["een"] * 200, [], own.encode
    monkeypatch.setattr(own, "encode", lambda texts, hints: calls.append(len(texts)) or encode_all(texts, hints))
    found = dict(encode._by_hints(own, list(range(200)), text, before))
    assert calls == [40, 80, 80] and [found[k][0] for k in range(5)] == [b"\xc8\xc8n", b"\xc8\xc8\xc9", b"\xc8\xc8\xc9", b"een", b"een"]
    assert dict(encode._by_hints(own, list(range(200)), text, before, most=9)) == found


def test_strings_of_composite_fonts_are_measured_at_once(monkeypatch):
    text, size = "αβ 中文😀", 12.0
    ranges = "begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\nendcmap\n".encode().hex()
    for spec, data in ((json.loads(WIDE_FONT), text.encode("utf-32-be")), ({"type0": True, "cmap": ranges, "cid_widths": [[65, 70, 250]]}, b"\0A\0 \0Z"), ({"base": "Helvetica"}, b"a b "), ({"type0": True}, b"\0A\0")):
        font = Font(spec)
        glyphs = font.glyphs(data)
        got = font.measured(data)
        want = ("".join(g.unicode for g in glyphs), len(glyphs), sum(g.byte_len == 1 and g.code == 32 for g in glyphs), sum(g.width for g in glyphs), glyphs[-1].byte_len == 1 and glyphs[-1].code == 32)
        assert got == (None if len(data) == 3 else want)
    assert Font({"type0": True, "cid_widths": [[65, 65, -250]]}).measured(b"\0A") is None
    page = interpret.Page({"F2": (font := Font(json.loads(WIDE_FONT)))}, {})
    monkeypatch.setattr(font, "glyphs", None)  # no glyph is made one by one
    page.run(f"BT /F2 {size} Tf 5 7 Td <{text.encode('utf-32-be').hex()}> Tj ET".encode(), "page:0", interpret.State())
    run = page.runs[0]
    assert (run["text"], run["n_glyphs"], run["n_spaces"], run["width_sum"], run["x0"]) == (text, 6, 0, 3600.0, 5.0) and abs(run["x1"] - 5 - 3.6 * size) < 1e-9
    assert interpret._font(WIDE_FONT) is interpret._font(WIDE_FONT)


def test_files_are_built_in_as_many_tasks_as_are_asked_for(spark):
    pages = spark.range(40).selectExpr("id % 20 AS doc_id", "cast(id div 20 AS int) AS page_index", "encode(concat('BT (', id, ') Tj ET'), 'UTF-8') AS content", "map('F1', '{\"base\": \"Courier\"}') AS fonts")
    files = pdf.documents(pages)
    assert "FlatMapGroupsInPandas" not in files._jdf.queryExecution().toString() and files.rdd.getNumPartitions() >= 4
    again = {(r.doc_id, r.page_index): bytes(r.content) for r in pdf.pages(files).collect()}
    assert again == {(k % 20, k // 20): b"BT (%d) Tj ET" % k for k in range(40)}


def test_edited_pieces_are_written_once_and_files_stay_dealt_out(spark):
    pages = spark.range(6).selectExpr("id AS doc_id", "0 AS page_index", "encode(concat('BT /F1 9 Tf 72 700 Td (one ', id, ') Tj 0 -20 Td (two) Tj ET'), 'UTF-8') AS content", "map('F1', '{\"base\": \"Helvetica\", \"encoding\": \"cp1252\"}') AS fonts")
    files = spark.createDataFrame(pdf.documents(pages).collect(), "doc_id long, content binary")
    read = spark.createDataFrame(pdf.pages(files).collect(), pdf.PAGES)
    runs = spark.createDataFrame(interpret.text_runs(read).collect(), interpret.RUNS)
    grouped = spark.createDataFrame(lines.group_lines(runs).collect(), lines.group_lines(runs).schema)
    edits = grouped.where("line_seq = 1").selectExpr("doc_id", "line_seq", "concat('E ', text) AS new_text", "'keep' AS overflow", "'left' AS anchor")
    edited, _ = encode.apply_edits(read, runs, grouped, edits)
    assert "MapInArrow" not in edited._jdf.queryExecution().toString()  # texts aren't encoded again by each reader
    done = pdf.patched(files, edited)
    assert done.rdd.getNumPartitions() >= 4
    again = lines.group_lines(interpret.text_runs(pdf.pages(done), lines.NEEDED))
    assert {(r.doc_id, r.line_seq, r.text) for r in again.collect()} == {x for k in range(6) for x in ((k, 1, f"E one {k}"), (k, 2, "two"))}
