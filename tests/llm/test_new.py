"""Mixing, periodic runs and importance resampling against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm import importance, mixing, queries, runs, totals

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int, row string, size string, pass int, h int"
LONG = "uno dos tres " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "hello big world of words", "en", "a"),
        (1, "hello big world of words", "en", "a"),
        (2, None, None, None),
        (None, "hello big world of words", "en", "a"),
        (None, "other", "en", "a"),
        (3, "", "en", "b"),
        (4, " \n\t ", None, "b"),
        (5, LONG, "es", "a"),
        (6, "1234 5678", "en", None),
    ]
    return spark.createDataFrame([(*r, 5, "x", 1, "r", "s", 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- running totals --------------------------------------------------------------------------------------------------


def test_running_totals_with_a_hot_key(spark):
    from pyspark.sql import functions as F

    rows = [(1 if k % 3 else k, k, k % 7) for k in range(900)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(5)
    got = {r.b: (r.before, r.n) for r in totals.running(df, [F.col("a").desc(), F.col("b")], {"before": F.col("v"), "n": F.lit(1).cast("long")}, "t").collect()}
    total = 0
    for n, (_, b, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1]))):
        assert got[b] == (total, n)
        total += v


# --- mixing ----------------------------------------------------------------------------------------------------------


def shares(sizes, weights, budget, most):
    """Targets by resharing, again and again, in exact fractions."""
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, weight = budget - sum(fixed.values()), sum(weights[s] for s in free)
        now = {s: Fraction(left) * weights[s] / weight for s in free}
        above = [s for s in free if now[s] > most * sizes[s]]
        if not above:
            return {**fixed, **now}
        fixed.update({s: Fraction(most * sizes[s]) for s in above})


def mixed(rows, seed=11):
    """(doc_id, size, source_size, target, taken) of each row, by filling one queue a source, copy by copy."""
    sized = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    names = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    sizes = {s: sum(n for _, n, x in sized if x == s) for s in names}
    budget = Fraction(3, 2) * sum(sizes.values())
    target = shares(sizes, weights, budget, 2)
    h = lambda d: int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    events = []
    for k, s in enumerate(names):
        upto = 0
        queue = sorted((h(d), (d is not None, d or 0), n, i) for i, (d, n, x) in enumerate(sized) if x == s)
        for turn in range(2):
            for place in queue:
                upto += place[2]
                events.append((upto / weights[s], k, turn, place))
    left, taken = math.floor(budget), Counter()
    for *_, (_, _, n, i) in sorted(events):
        taken[i] += min(n, left)
        left -= min(n, left)
    return sorted(((d, n, sizes[s], pytest.approx(float(target[s])), taken[i]) for i, (d, n, s) in enumerate(sized)), key=lambda r: (r[0] or 0, r[1], r[4]))


def by_doc(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] or 0, r[1], r[4]))


def test_mixing_against_queues(docs):
    got = mixing.schedule(docs).collect()
    assert by_doc(got) == mixed([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert by_doc(mixing.schedule(docs.repartition(7)).collect()) == by_doc(got)  # the same whatever the partitions
    assert all(r.taken <= 2 * r.size for r in got)


def test_mixing_same_as_sql(spark, docs):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = db.execute(queries.ORACLE_SQL["op11_mixing"]).fetchall()
    assert by_doc(mixing.schedule(docs).collect()) == by_doc(want)


def test_mixing_of_odd_rows(odd, none):
    out = mixing.schedule(odd)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert by_doc(out.collect()) == mixed([(r.doc_id, r.text, r.source) for r in odd.collect()])
    assert mixing.schedule(none).count() == 0 and mixing.mix(none).count() == 0
    empty = mixing.schedule(odd.where("doc_id in (2, 3, 4)")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in empty) == [(k, 0, 0.0, 0) for k in (2, 3, 4)]


def test_mixing_joins_many_sources_without_broadcast(spark, docs):
    rows = spark.createDataFrame([(k, "a b c", f"s{k % 50}") for k in range(200)], "doc_id long, text string, source string")
    assert by_doc(mixing.schedule(rows, broadcast_sources=0).collect()) == by_doc(mixing.schedule(rows).collect())


def test_mix_is_the_schedule_in_order(odd):
    out = mixing.mix(odd).collect()
    assert list(out[0].asDict()) == [*[c for c in odd.columns if c != "pass"], "pass", "position", "taken"]
    words = [len((r.text or "").split()) for r in out]
    assert [r.position for r in out] == [sum(words[:k]) for k in range(len(out))] and all(r.taken == n for r, n in zip(out[:-1], words))
    took = Counter()
    for r in out:
        took[r.doc_id] += r.taken
    want = Counter()
    for r in mixing.schedule(odd).collect():
        want[r.doc_id] += r.taken
    assert +took == +want


# --- runs ------------------------------------------------------------------------------------------------------------


def plain_runs(x):
    """Every run by trying every period."""
    found = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def numbers(x):
    return np.array([1 + sorted(set(x)).index(w) for w in x], "i8")


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        a, b = rng.integers(0, runs.PRIME, (3, size)), rng.integers(0, runs.PRIME, (3, size))
        assert (runs.untransformed(runs.transformed(a)) == a).all()
        both = runs.untransformed(runs.transformed(a) * runs.transformed(b) % runs.PRIME)
        for r in range(3):
            want = [sum(int(a[r, i]) * int(b[r, (k - i) % size]) for i in range(size)) % runs.PRIME for k in range(size)]
            assert both[r].tolist() == want


def test_occurrences_of_blocks():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 3, 300)
    for block, nearest in ((8, 1), (16, 16), (32, 32)):
        starts = np.arange(0, len(x) - block + 1, block)
        want = {(s, d) for s in starts.tolist() for d in range(nearest, 2 * block) if s + d + block <= len(x) and (x[s : s + block] == x[s + d : s + d + block]).all()}
        assert set(zip(*[a.tolist() for a in runs.occurrences(x, starts, block, nearest)])) == want


def test_runs_against_every_period():
    rng = random.Random(3)
    cases = []
    for _ in range(400):
        x, letters = [], rng.choice([1, 2, 2, 3, 5, 50])
        while len(x) < 400:
            part = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 15, 16, 17, 31, 33, 40]))]
            x += (part * 400)[: rng.randint(1, 6 * len(part) + 30)] if rng.random() < 0.6 else [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
        cases.append(x[: rng.randint(0, 400)])
    a, b = "a", "ab"
    while len(b) < 800:
        a, b = b, b + a
    cases += [list(b), list("a" * 700), list("ab" * 300), list(("a" * 100 + "b") * 7), list(("aab" * 11 + "c") * 12)]
    assert sum(len(plain_runs(x)) for x in cases) > 500
    for x in cases:
        assert list(map(tuple, runs.runs(numbers(x)).tolist())) == plain_runs(x)


def test_long_runs_of_a_long_text():
    for n, period in ((300_000, 1), (300_000, 7), (300_000, 99_999)):
        assert runs.runs(1 + np.arange(n) % period).tolist() == [[0, n, period]]


def test_greatest_exponent_is_exact():
    found = np.array([[5, 3 * 10**6, 10**6], [9, 3 * 10**6 + 3, 10**6 + 1], [2, 3 * 10**6 - 3, 10**6 - 1], [0, 3 * 10**6 - 1, 10**6]])
    assert runs.greatest(found) == (2, 3 * 10**6 - 3, 10**6 - 1)


def run_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    inside = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc, len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in inside))


def test_run_query_against_brute_force(spark, docs):
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 8000]
    rows = [*short, *[(1000 + k, "x y " * k + "tail of it") for k in range(60)], (None, "a " * 40), (7, None), (8, " \n"), (8, " \n"), (9, "  " * 30 + "\x1c " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = runs.find(df, modify=True)
    from pyspark.sql import functions as F

    got = found.select("doc_id", *runs.LONGS, "runs_sha256", F.sha2("collapsed", 256))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((run_row(*r) for r in rows), key=str)
    assert sum(run_row(*r)[1] > 0 for r in rows) > 30


def test_runs_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in runs.find(odd).collect()}
    assert got[5].n_runs == 1 and (got[5].start, got[5].length, got[5].period, got[5].exponent_milli) == (0, 60_000, 3, 20_000_000)
    assert got[5].collapsed == "uno dos tres" and got[2].collapsed == "" and got[2].n_runs == 0 and got[2].period is None
    assert runs.find(odd).count() == odd.count() and runs.find(none, modify=True).count() == 0


# --- importance ------------------------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_features_of_odd_texts():
    rng, own = random.Random(4), importance.Splitter(most=200)
    pieces = ["a", "Bc", "É", "é", "中文", "😀", "x" * 70, "é" * 40, "12", "foo_bar", "İ", "\x85", " ", "\n", "--", " ", "don't", "z" * 5000]
    texts = [None, "", *["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randint(0, 12))) for _ in range(1000)]]
    for k in range(0, len(texts), 90):
        part = texts[k : k + 90]
        counts, found, of = own.features(pa.array(part, pa.string()))
        for i, text in enumerate(part):
            assert (counts[i], sorted(found[of == i].tolist())) == (buckets(text)[0], sorted(buckets(text)[1])), repr(text)


def test_long_texts_are_split_in_parts(monkeypatch):
    text = "Eine lange Zeile; " * 500 + "ohneende" * 300
    monkeypatch.setattr(importance, "PART", 50)
    counts, found, _ = importance.Splitter().features(pa.array([text]))
    assert (counts[0], sorted(found.tolist())) == (buckets(text)[0], sorted(buckets(text)[1]))


def resampled(rows, target):
    """(doc_id, n_features, weight, score, rank) of each row in plain Python."""
    raw, aim = Counter(), Counter()
    for _, text in rows:
        raw.update(buckets(text)[1])
    for text in target:
        aim.update(buckets(text)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for doc, text in rows:
        n, found = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = resampled(rows, [r.text for r in bench.collect()])
    assert sorted(map(tuple, queries.op13_importance(spark, SMALL).collect()), key=str) == want
    assert sum(r[4] is not None for r in want) == 5 * sum(buckets(t)[0] >= 20 for _, t in rows) // 100 > 0


def test_importance_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = importance.resample(odd, odd).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, [t for _, t in rows])
    same = importance.resample(odd, none, percent=100, min_words=2).collect()  # ties between rows of one id
    assert sorted(r.rank for r in same if r.rank) == [1, 2, 3, 4, 5] and all(r.n_words >= 2 for r in same if r.rank)
    assert importance.resample(none, odd).count() == 0 and importance.resample(none, none).count() == 0


def test_every_query_of_the_three_runs(spark):
    sizes = defaultdict(int, {name: queries.QUERIES[name](spark, SMALL).count() for name in ("op11_mixing", "op12_runs", "op13_importance")})
    assert set(sizes.values()) == {spark.read.parquet(f"{SMALL}/documents.parquet").count()}
