"""Near-duplicate vectors by Euclidean p-stable hashing (operator 3).

Vectors of one label are normalised; each of several tables gives a vector the bucket of its quantised Gaussian
projections floor((a.v + b) / width). Vectors that share a bucket are compared by their exact cosine in double
precision. On the unit sphere the threshold is a distance, so the number of projections per table follows from how
many vectors the largest label has (buckets of unrelated vectors stay small), and the number of tables from the
chance ``miss`` with which a pair exactly at the threshold may share no bucket; closer pairs are missed far less
often. The same formulas hold at every size.

Plan: equal vectors of a label become one weighted vector first. Buckets are dealt out and sorted by Spark and
compared block by block with matrix products; a bucket of more than ``BLOCK`` vectors is split into blocks, and each
pair of blocks is a unit of work of its own. A pair that shares several buckets counts in the first one only. Per
block only the sums and one edge per vector (to the smallest vector of its local component) leave the task, never the
pairs. Components are contracted over these edges.

Defined results: null, empty or zero vectors, vectors with null or non-finite components, and null labels link with
nothing (n_links 0, own component); vectors of different length don't link with each other; rows without a key link
with nothing (component null, kept); repeated rows are vectors of their own and count as links of each other; keys are
taken to be unique otherwise; a cosine equal to the threshold links; other columns, whatever their names, take no part;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import written
from quirefold.llm.components import components

#: Vectors of a bucket that are compared at once.
BLOCK = 1024
WIDTH = 2.0


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection of two points at this distance is equal."""
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(largest: int, threshold: float, miss: float = 0.002, bucket: int = 64) -> tuple[int, int]:
    """(projections per table, tables) for the number of vectors of the largest label."""
    k = max(4, math.ceil(math.log(max(largest, 1) / bucket) / -math.log(collision(math.sqrt(2))))) if largest > bucket else 4
    near = collision(math.sqrt(2 - 2 * threshold)) ** k
    return k, math.ceil(math.log(miss) / math.log(1 - near))


def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, k, tables, 3])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)


def bucket_keys(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """uint32 (vectors, tables): a hash of each table's k quantised projections."""
    a, b, odd = _projections(unit.shape[1], k, tables)
    cells = np.floor((unit @ a + b) / WIDTH).astype("i8").view("u8").reshape(len(unit), tables, k)
    mixed = (cells * odd).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype("u4")


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(raw: list[bytes]) -> np.ndarray:
    return unit_vectors(np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1))


def compare(unit: np.ndarray, keys: np.ndarray, table: int, ids: np.ndarray, weight: np.ndarray, block: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links that count here, smallest id of the local component) per vector of a unit of work.

    block: which of the two blocks a vector is in; cross: only pairs between the two count.
    """
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if cross:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(linked)
    fresh = ~(keys[i, :table] == keys[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
    n = np.bincount(i[fresh], weights=weight[j[fresh]].astype(float), minlength=len(ids)).astype("i8")
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        if (new == root).all():
            return n, root
        root = new


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of sorted rows ends; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= batch.column(k).to_numpy() == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and any(held[-1].column(k)[0].as_py() != v for k, v in zip(keys, last)):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """key, n_links, component_id, kept: one row per input row."""
    v = F.col("v")
    usable = F.col("id").isNotNull() & v.isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    same = F.when(F.col("ok"), F.struct(F.xxhash64("label", "v").alias("x"), F.xxhash64("v", "label", F.lit(5)).alias("y")))
    rows = rows.withColumn("same", same)
    classes = written(rows.where("ok").groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan(largest, threshold)
    # a 64-bit group: label and length
    source = classes.select("rep", "copies", F.xxhash64("label", F.size("v")).alias("grp"), "v")

    def unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = part.column(3).flatten().to_numpy().reshape(-1, dim)
                yield part, x, bucket_keys(unit_vectors(x), k, tables)

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, keys in unit_batches(batches):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(2).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype="i4"), n)), pa.array(keys.reshape(-1).astype("i8"))], names=["grp", "tab", "bucket"])

    def with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, keys in unit_batches(batches):
            for i in range(0, part.num_rows, 500):
                own, n = part.slice(i, 500), min(500, part.num_rows - i)
                rep = lambda a: pa.array(np.repeat(a, tables))  # noqa: B023, E731
                many = lambda a: pa.array([b for r in a for b in [r.tobytes()] * tables], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [rep(own.column(2).to_numpy()), pa.array(np.tile(np.arange(tables, dtype="i4"), n)), pa.array(keys[i : i + n].reshape(-1).astype("i8")), rep(own.column(0).to_numpy()), rep(own.column(1).to_numpy()), many(keys[i : i + n]), many(x[i : i + n])],
                    names=["grp", "tab", "bucket", "rep", "copies", "keys", "vec"],
                )

    big = written(source.mapInArrow(only_keys, "grp bigint, tab int, bucket bigint").groupBy("grp", "tab", "bucket").count().where(F.col("count") > BLOCK), "buckets")
    n_big = big.count()
    spread = source.mapInArrow(with_vectors, "grp bigint, tab int, bucket bigint, rep bigint, copies bigint, keys binary, vec binary")
    if n_big:  # few enough to send along, or else joined by bucket
        spread = spread.join(F.broadcast(big) if n_big <= 100_000 else big, ["grp", "tab", "bucket"], "left")
        blocks = F.ceil(F.col("count") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        one = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
        pairs = F.when(F.col("count").isNull(), one).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda q: F.struct(F.least(own, q).alias("p"), F.greatest(own, q).alias("q"))))
        spread = spread.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("pq", F.explode(pairs)).select("grp", "tab", "bucket", F.col("pq.p").alias("p"), F.col("pq.q").alias("q"), "own", "rep", "copies", "keys", "vec")
    else:
        zero = F.lit(0)
        spread = spread.select("grp", "tab", "bucket", zero.alias("p"), zero.alias("q"), zero.alias("own"), "rep", "copies", "keys", "vec")
    group = ["grp", "tab", "bucket", "p", "q"]
    dealt = spread.repartition(*group).sortWithinPartitions(*group)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, group):
            cols = [t.column(c).to_numpy() for c in group]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = np.append(np.flatnonzero(new), t.num_rows)
            rep, copies, own = (t.column(c).to_numpy() for c in ("rep", "copies", "own"))
            ids, links, roots = [], [], []
            for a in np.flatnonzero(np.diff(starts) > 1):
                s, e = starts[a], starts[a + 1]
                unit = _units(t.column("vec").slice(s, e - s).to_pylist())
                keys = np.frombuffer(b"".join(t.column("keys").slice(s, e - s).to_pylist()), "u4").reshape(e - s, -1)
                n, root = compare(unit, keys, int(cols[1][s]), rep[s:e], copies[s:e], own[s:e], cols[3][s] != cols[4][s], threshold)
                some = (n > 0) | (root != rep[s:e])
                ids.append(rep[s:e][some]), links.append(n[some]), roots.append(root[some])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, links, roots)], names=["rep", "n", "root"])

    found = written(dealt.mapInArrow(compared, "rep bigint, n bigint, root bigint").groupBy("rep", "root").agg(F.sum("n").alias("n")), "links")
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = classes.select("same", "rep", "copies").join(sums, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "same").join(classes, "same", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
