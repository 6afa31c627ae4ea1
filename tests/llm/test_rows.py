"""Every operator on nulls, empty texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from quirefold.llm import bpe, html, language, lines, minhash, packing, pii, planes, quality, vectors

P = pytest.importorskip("public_tokenizers")
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int, _qf_t string"
LONG = "uno dos tres " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, an empty and a blank text, a very long one, repeated rows, columns with unlucky names."""
    rows = [
        (1, "hello big world of words", "en", "a", 5, "x", 1, "t"),
        (1, "hello big world of words", "en", "a", 5, "x", 1, "t"),
        (2, None, None, None, None, None, None, None),
        (None, "hello big world of words", "en", "a", 5, None, None, None),
        (3, "", "en", "b", 0, "y", 2, ""),
        (4, " \n\t ", None, "b", 4, "y", 2, ""),
        (5, LONG, "es", "a", len(LONG), "z", 3, "u"),
        (6, "1234 5678", "en", None, 9, "z", 3, "u"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_html(spark):
    rows = [(1, "u", None, "keep"), (2, "u", "", "keep"), (3, "u", "<article><p>a &amp; b  c</p><p>d", "keep"), (3, "u", "<article><p>a &amp; b  c</p><p>d", "keep"), (None, None, "<<<>&#x0;<p", None)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "a & b c\nd", 9), (3, "a & b c\nd", 9)] and len(got) == 5
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_lines(odd, none):
    out = lines.drop_boilerplate(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count()
    got = by_id(out.collect())
    assert got[2].text is None and got[2].n_lines == 0 and got[3].text == "" and got[4].text == " \n\t "
    assert got[1].text == "" and got[1].n_dropped == 1  # on three of the four pages of its host
    assert got[6].text == "1234 5678"  # no host
    assert lines.drop_boilerplate(none).count() == 0


def test_pipeline_keeps_a_text_of_a_group_of_copies(spark):
    import corpus_pipeline

    rows = [(k, "one of many\nof the same" if k < 20 else f"menu\npage {k}", "en", "a", 9) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert got == {k: ("one of many\nof the same", 23) if k < 20 else (f"page {k}", 7) for k in range(60)}


def test_language(odd, none):
    out = language.identify(odd)
    got = by_id(out.collect())
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == odd.count()
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (2, 3, 4, 6))
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    assert language.identify(none).count() == 0
    untrained = language.predict(odd, language.train(none))
    assert {r.lang_pred for r in untrained.collect()} == {"und"} and untrained.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1)]
    out = vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert got == {(1, 2, 1, True), (2, 2, 1, False)} | {(k, 0, k, True) for k in range(3, 12)}
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pii(odd, none):
    got = by_id(pii.find(odd).collect())
    assert all(r.pii == [] for r in got.values()) and pii.find(odd).count() == odd.count()
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and sorted(map(str, masked.collect())) == sorted(map(str, odd.collect()))
    assert pii.find(none).count() == 0 and pii.mask(none).count() == 0


def test_quality(odd, none):
    out = quality.judge(odd)
    got = by_id(out.collect())
    assert out.count() == odd.count() and got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[5].n_words == 60_000 and got[5].n_repeat_words == 60_000 and got[5].base_failed
    assert quality.judge(none).count() == 0


def test_packing(odd, none):
    out = packing.pack(odd, WORDS).collect()
    assert len([r for r in out if r.doc_id == 1]) == 2 and by_id(out)[2].length == 1 and by_id(out)[3].ids == b"\x02\0\0\0"
    assert sum(r.length for r in out if r.doc_id == 5) == by_id(out)[5].doc_tokens and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert packing.pack(none, WORDS).count() == 0


def test_bpe(odd, none):
    both = bpe.decode(bpe.encode(odd, BYTES, P.PATTERN), BYTES, P.PATTERN)
    got = by_id(both.collect())
    assert got[2].ids == [] and bytes(got[3].decoded) == b"" and bytes(got[5].decoded) == LONG.encode() and both.count() == odd.count()
    assert bpe.encode(none, BYTES, P.PATTERN).count() == 0


def test_planes(odd, none):
    got = planes.round_trip(odd, WORDS).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))] and bytes(got[3].ids) == b"\x02\0\0\0"
    assert planes.round_trip(none, WORDS).count() == 0


def test_minhash(odd, none):
    got = sorted(((r.doc_id, r.group_id, r.kept) for r in minhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), *((k, k, True) for k in range(2, 7))], key=str)
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicate(none).count() == 0


def test_pipeline(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "packing":
                assert out.columns == docs.columns
                docs = out.withColumn("text", F.col("text"))
            out.count()
