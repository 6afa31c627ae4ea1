"""State under save and restore as windows, against stacks in plain Python and the fold of pages."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import geometry
from quirefold.operators import interpret, state
from quirefold.sources.typeset import typeset


def stacked(rows):
    """(key, seq, level, value, matrix) after each row, with a stack."""
    out, now = [], {}
    for key, seq, kind, arg in rows:
        value, m, stack = now.get(key, (None, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), []))
        if kind == "q":
            stack = [*stack, (value, m)]
        elif kind == "Q" and stack:
            (value, m), stack = stack[-1], stack[:-1]
        elif kind == "set":
            value = arg
        elif kind == "cm":
            m = interpret._mul((float(arg % 3 - 1), 1.0, 0.0, 1.0, float(arg), 2.0), m)
        now[key] = value, m, stack
        out.append((key, seq, len(stack), value, m))
    return out


@pytest.mark.parametrize("weights", [(3, 3, 3, 2), (5, 2, 1, 1), (2, 5, 2, 2), (1, 1, 0, 4)])
def test_scopes_against_stacks(spark, weights):
    rng = random.Random(sum(weights))
    rows = [(k, i, rng.choices(["q", "Q", "set", "cm"], weights)[0], i) for k in (1, 2, None) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, seq int, kind string, arg int").repartition(3)
    kind = F.col("kind")
    found = state.scopes(df, ["k"], "seq", kind == "q", kind == "Q")
    found = state.in_scope(found, ["k"], "seq", {"value": F.when(kind == "set", F.col("arg"))})
    arg = F.col("arg").cast("double")
    found = state.transformed(found, ["k"], "seq", F.when(kind == "cm", geometry.matrix(F.col("arg") % 3 - 1, 1, 0, 1, arg, 2)))
    got = {(r.k, r.seq): (r.level, r.value, tuple(r.ctm)) for r in found.collect()}
    assert got == {(k, i): (level, value, m) for k, i, level, value, m in stacked(rows)}


def test_scopes_without_rows(spark):
    none = spark.createDataFrame([], "k int, seq int, kind string")
    found = state.scopes(none, ["k"], "seq", F.col("kind") == "q", F.col("kind") == "Q")
    assert state.in_scope(found, ["k"], "seq", {"v": F.col("kind")}).count() == 0


SAME = ["font_name", "font_size", "char_spacing", "word_spacing", "horiz_scale", "leading", "rise", "render_mode", "line_width"]


def same_as_fold(pages):
    """Rows of both, keyed by page and first byte; the fold has no fonts, so shows advance nothing."""
    extra = pages.select("doc_id", "page_index", *[c for c in ("states", "spaces") if c in pages.columns])
    rows = state.text_states(interpret.operators(pages).join(extra, ["doc_id", "page_index"])).collect()
    got = {(r.doc_id, r.page_index, r.start): (*[r[c] for c in SAME], r.fill, r.stroke, list(r.ctm), list(r.line_matrix)) for r in rows}
    runs = interpret.text_runs(pages).collect()
    want = {(r.doc_id, r.page_index, r.start): (*[r[c] for c in SAME], r.fill, r.stroke, r.ctm, r.text_matrix) for r in runs}
    assert got.keys() == want.keys() and len(got) == len(rows) == len(runs)
    for k, a in want.items():
        assert got[k][:9] == a[:9] and all(x == (None if y is None else pytest.approx(y)) for x, y in zip(got[k][9:], a[9:], strict=True)), (k, got[k], a)
    return len(got)


def test_random_pages_as_the_fold_has_them(spark):
    rng = random.Random(8)
    n = lambda a=-9, b=9: str(rng.randint(a, b))
    makers = [
        lambda: "q", lambda: "Q", lambda: f"{n(1, 2)} 0 {n(0, 1)} {n(1, 2)} {n()} {n()} cm", lambda: f"{n()} Tc", lambda: f"{n()} Tw", lambda: f"{n(50, 150)} Tz", lambda: f"{n()} TL", lambda: f"{n()} Ts", lambda: f"{n(0, 7)} Tr",
        lambda: f"/F{n(1, 3)} {n(1, 20)} Tf", lambda: f"{n()} {n()} Td", lambda: f"{n()} {n()} TD", lambda: "T*", lambda: f"{n(1, 3)} 0 {n(0, 2)} 1 {n()} {n()} Tm", lambda: "BT", lambda: "ET", lambda: "(a) Tj", lambda: "(a) '",
        lambda: f"{n()} {n()} (a) \"", lambda: "[(a) (b)] TJ", lambda: "[] TJ", lambda: f"0.{n(0, 9)} g", lambda: f"0.{n(0, 9)} 1 0 rg", lambda: f"0.{n(0, 9)} 0 1 0.5 k", lambda: f"/{rng.choice(['DeviceRGB', 'G', 'CMYK', 'Own'])} cs",
        lambda: f"0.{n(0, 9)} 0.2 0.3 sc", lambda: "0.5 scn", lambda: "/P1 scn", lambda: "0.1 0.2 0.3 0.4 scn", lambda: "Tc", lambda: "2 TD", lambda: f"/G{n(1, 4)} gs",
        lambda: f"{n(0, 9)} w", lambda: f"0.{n(0, 9)} G", lambda: f"0.{n(0, 9)} 1 0 RG", lambda: f"0.{n(0, 9)} 0 1 0.5 K", lambda: f"/{rng.choice(['DeviceRGB', 'G', 'CMYK', 'Own', 'None'])} CS", lambda: f"0.{n(0, 9)} 0.2 0.3 SC", lambda: "/P1 SCN", lambda: "0.5 SCN",
    ]
    rows = [(d, p, ("BT " + "\n".join(rng.choice(makers)() for _ in range(rng.randint(0, 120)))).encode(), {}, {"G1": (7.0, True), "G2": (8.0, False), "G3": (9.0, True)}, {"Own": "cmyk"}) for d in range(12) for p in range(3)]
    kind = "doc_id long, page_index int, content binary, fonts map<string,string>, states map<string,struct<size:double,named:boolean>>, spaces map<string,string>"
    assert same_as_fold(spark.createDataFrame(rows, kind)) > 150


def test_deep_nesting(spark):
    content = b"BT " + b"".join(b"q 1 0 0 1 1 0 cm %d Tc (a) Tj " % k for k in range(300)) + b"Q (b) Tj " * 310
    assert same_as_fold(spark.createDataFrame([(1, 0, content, {})], "doc_id long, page_index int, content binary, fonts map<string,string>")) == 610


def test_typeset_pages_as_the_fold_has_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = typeset(docs).select("doc_id", "page_index", "content", F.create_map().cast("map<string,string>").alias("fonts"))
    assert same_as_fold(pages) > 1000
