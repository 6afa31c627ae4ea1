"""Ranges with priority, as-of joins and overlaps of boxes against loops."""

import random

from pyspark.sql import functions as F

from quirefold.operators import ranges


def test_dyadic_blocks_make_up_the_range(spark):
    rng = random.Random(1)
    pairs = [(0, 0), (5, 4), (-3, 3), (0, (1 << 40) - 1), *[tuple(sorted((rng.randint(-200, 200), rng.randint(-200, 200)))) for _ in range(100)]]
    for r in spark.createDataFrame(pairs, "lo long, hi long").withColumn("d", ranges.dyadic(F.col("lo"), F.col("hi"))).collect():
        if r.hi - r.lo < 1000:
            codes = [c for b in r.d for c in range(b.block << b.level, (b.block + 1) << b.level)]
            assert sorted(codes) == list(range(r.lo, r.hi + 1)), r
        assert len(r.d) <= max(1, 2 * max(r.hi - r.lo + 1, 1).bit_length())


def test_the_last_range_wins(spark):
    rng = random.Random(2)
    given = [(k, s, a, a + rng.choice([0, 3, 40, 10**9]), f"v{k}.{s}") for k in (1, 2, None) for s, a in enumerate(rng.choices(range(-60, 60), k=25))] + [(1, 99, 5, 4, "empty")]
    codes = [(k, c) for k in (1, 2, 3, None) for c in [*range(-70, 110, 3), 10**9 + 5, -(10**12)]]
    df = spark.createDataFrame(given, "k int, seq int, lo long, hi long, v string")
    got = sorted(map(tuple, ranges.in_last_range(spark.createDataFrame(codes * 2, "k int, code long").repartition(5), "code", df, ["k"], "v").collect()), key=str)
    won = lambda k, c: max(((s, v) for q, s, lo, hi, v in given if q == k and lo <= c <= hi), default=(0, None))[1]
    assert got == sorted([(k, c, won(k, c)) for k, c in codes] * 2, key=str)
    cut = ranges.disjoint(df, ["k"], "v").where("k = 1").orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(cut, cut[1:])) and {r.v for r in cut} <= {g[4] for g in given}
    none = spark.createDataFrame([], df.schema)
    assert {r.v for r in ranges.in_last_range(spark.createDataFrame(codes, "k int, code long"), "code", none, ["k"], "v").collect()} == {None}


def test_as_of_with_one_key_over_many_ranges(spark):
    steps = [(1, 10 * k, k) for k in range(5)] + [(2, 7, 70)]
    rows = [(1, c, c) for c in range(-5, 400)] + [(2, 6, 0), (2, 7, 1), (3, 1, 2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranges.as_of(spark.createDataFrame(rows, "k int, at long, _qf_x int"), "at", spark.createDataFrame(steps, "k int, place long, n int"), "place", ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(k, c): max(((p, n) for q, p, n in steps if q == k and p <= c), default=None) for k, c, _ in rows}
    assert {(r.k, r["at"]): r.step and (r.step.place, r.step.n) for r in out} == want and len(out) == len(rows)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    size = lambda: rng.choice([0.0, 0.25, 1.0, 3.0, 10.0, 300.0])
    boxes = [(k % 3, k, (rng.uniform(-20, 20) // 0.5 * 0.5, rng.uniform(-20, 20) // 0.5 * 0.5, size(), size())) for k in range(300)]
    boxes += [(5, 1000 + k, (1.0, 1.0, 2.0, 2.0)) for k in range(40)]  # a hot cell
    odd = [(None, 2000, (0.0, 0.0, 9.0, 9.0)), (0, 2001, None), (0, 2002, (0.0, 0.0, -1.0, 5.0)), (0, 2003, (float("nan"), 0.0, 1.0, 1.0))]
    df = spark.createDataFrame(boxes + odd, "page int, id long, box struct<x:double,y:double,width:double,height:double>")
    want = set()
    for k, a, r in boxes:
        for j, b, s in boxes:
            if k == j and a < b and r[0] < s[0] + s[2] and s[0] < r[0] + r[2] and r[1] < s[1] + s[3] and s[1] < r[1] + r[3]:
                want.add((k, a, b))
    for hot in (2000, 7):
        pairs = ranges.overlapping(df, ["page"], hot=hot)
        rows = list(map(tuple, pairs.collect()))
        assert set(rows) == want and len(rows) == len(want) > 1000
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    assert ranges.overlapping(spark.createDataFrame([], df.schema), ["page"]).count() == 0


def test_wide_ranges_make_as_many_rows_as_codes_need(spark, monkeypatch):
    made = []
    keep = ranges.stored
    monkeypatch.setattr(ranges, "stored", lambda df, name: made.append((name, found := keep(df, name))) or found)
    given = spark.createDataFrame([(k % 3, k, 7 * k, 7 * k + (1 << 40) + k, f"v{k}") for k in range(200)], "k int, seq long, lo long, hi long, v string")
    codes = spark.createDataFrame([(k % 3, 10**6 * k, k) for k in range(30)], "k int, code long, n int")
    got = {(r.k, r.code): r.v for r in ranges.in_last_range(codes, "code", given, ["k"], "v").collect()}
    assert got == {(k % 3, 10**6 * k): f"v{197 + (k + 1) % 3}" if k else "v0" for k in range(30)}
    blocks = [df.count() for name, df in made if name == "blocks"]
    assert blocks and max(blocks) <= 2 * 30  # by numbers of codes; by codes of 40 bits there were thousands
