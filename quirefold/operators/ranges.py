"""Ranges with priority and overlaps of boxes as equi-joins, whatever the widths.

Ranges are cut into dyadic blocks (level, number): of any two ranges' blocks, one holds the other or they are apart. A
range of n places has at most 2 log2(n) blocks, and a place lies in one block of each level. Places are not codes, but the
numbers of the codes (or ends) that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import geometry
from quirefold.operators.stored import stored

PART = "_qf_part"


def dyadic(lo: Column, hi: Column) -> Column:
    """array<struct<level,block>> of the fewest blocks that make up the codes from lo to hi; empty if hi < lo.

    From both ends inwards: an end that has no partner at its level is a block of its own.
    """
    start = F.struct(lo.cast("long").alias("l"), (hi.cast("long") + 1).alias("r"), F.array().cast("array<struct<level:int,block:bigint>>").alias("found"))

    def step(s: Column, level: Column) -> Column:
        block = lambda n: F.struct(level.cast("int").alias("level"), n.alias("block"))
        odd_l, odd_r = (s["l"] < s["r"]) & (s["l"].bitwiseAND(F.lit(1)) == 1), (s["l"] < s["r"]) & (s["r"].bitwiseAND(F.lit(1)) == 1)
        first = F.when(odd_l, F.array(block(s["l"]))).otherwise(F.expr("array()").cast("array<struct<level:int,block:bigint>>"))
        left = s["l"] + odd_l.cast("long")
        last = F.when(odd_r & (left < s["r"]), F.array(block(s["r"] - 1))).otherwise(F.expr("array()").cast("array<struct<level:int,block:bigint>>"))
        right = s["r"] - odd_r.cast("long")
        return F.struct(F.shiftright(left, 1).alias("l"), F.shiftright(right, 1).alias("r"), F.concat(s["found"], first, last).alias("found"))

    # ends meet after as many steps as the length has bits, or one more
    steps = F.least(F.lit(62), F.ceil(F.log2(F.greatest(F.lit(1.0), hi.cast("double") - lo.cast("double") + 1))).cast("int") + 1)
    return F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda s: s["found"])


def _numbered(points: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``points`` (keys, at, different ones) with _qf_n: their number in the order of keys and place, from 0 on."""
    dealt = stored(points.repartitionByRange(*keys, at).withColumn(PART, F.spark_partition_id()), "points")
    return _offset(dealt.withColumn("_qf_n", F.row_number().over(Window.partitionBy(PART).orderBy(*keys, at)) - 1), dealt.groupBy(PART).agg(F.count("*").alias("_qf_c")), "_qf_n")


def _offset(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """``rows`` with what earlier parts count added to ``name``; counts (part, _qf_c): one row for each task that made them."""
    before = {r[PART]: r["_qf_c"] for r in counts.collect()}
    total, starts = 0, []
    for part in range(max(before, default=-1) + 1):
        starts.append(total)
        total += before.get(part, 0)
    first = F.get(F.array(*map(F.lit, starts)) if starts else F.array().cast("array<bigint>"), F.col(PART)).cast("long")
    return rows.withColumn(name, first + F.col(name)).drop(PART)


def _counted(rows: DataFrame, at: Column, points: DataFrame, keys: list[str], place: str, own: bool, name: str) -> DataFrame:
    """``rows`` with ``name``: how many points come before ``at`` in the order of keys and place; with ``own`` those at it count.

    One row a row and a point, dealt together into ranges of (keys, place); a task's earlier points are one number.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    left = rows.select(*keys, at.cast("long").alias("_qf_at"), F.lit(1 if own else -1).alias("_qf_side"), row.alias("_qf_row"))
    right = points.select(*keys, F.col(place).cast("long").alias("_qf_at"), F.lit(0).alias("_qf_side"), F.lit(None).cast(left.schema["_qf_row"].dataType).alias("_qf_row"))
    order = [*keys, "_qf_at", "_qf_side"]
    both = stored(left.union(right).repartitionByRange(*order, F.xxhash64("_qf_row")).withColumn(PART, F.spark_partition_id()), "counted")
    upto = F.count_if(F.col("_qf_side") == 0).over(Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn(name, upto).where("_qf_side != 0")
    return _offset(found, both.groupBy(PART).agg(F.count_if(F.col("_qf_side") == 0).alias("_qf_c")), name).select("_qf_row.*", name)


def _won(points: DataFrame, ranges: DataFrame, keys: list[str], place: str, value: str, seq: str) -> DataFrame:
    """keys, place, _qf_n, w: the numbered points (see ``_numbered``) that a range holds, with w, struct<seq,value> of the
    last one.

    Ranges are cut into blocks of the points' numbers, not of codes: a range of n points makes some 2 log2(n) rows at most,
    one without points none. So rows follow the points that ranges meet, however wide they are.
    """
    whole = ranges.where("lo <= hi").select(*keys, "lo", "hi", seq, value)
    found = _counted(_counted(whole, F.col("lo"), points, keys, place, False, "_qf_l"), F.col("hi"), points, keys, place, True, "_qf_r")
    blocks = found.where("_qf_l < _qf_r").select(F.struct(seq, value).alias("w"), F.explode(dyadic(F.col("_qf_l"), F.col("_qf_r") - 1)).alias("b")).select("b.level", "b.block", "w")
    best = stored(blocks.groupBy("level", "block").agg(F.max_by("w", f"w.{seq}").alias("w")), "blocks")
    levels = sorted(r[0] for r in best.select("level").distinct().collect())  # 63 at most
    each = points.select(*keys, place, "_qf_n", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
    met = each.withColumn("block", F.expr("shiftright(_qf_n, level)")).join(best, ["level", "block"])
    return met.groupBy(*keys, place, "_qf_n").agg(F.max_by("w", f"w.{seq}").alias("w"))


def disjoint(ranges: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """keys, lo, hi, seq, value: ranges that don't overlap, each with what the last range (greatest seq) says that holds it.

    ranges: keys, lo, hi (inclusive, integers), seq, value. A range is cut at the ends of others; the winner between two
    ends is the greatest seq of the blocks of ends that hold the first. A row makes some 2 log2(ends that it holds) rows.
    """
    whole = ranges.where("lo <= hi")
    ends = whole.select(*keys, F.explode(F.array(F.col("lo").cast("long"), F.col("hi").cast("long") + 1)).alias("lo")).distinct()
    ends = stored(_numbered(ends, keys, "lo"), "ends")
    follower = ends.select((F.col("_qf_n") - 1).alias("_qf_n"), (F.col("lo") - 1).alias("hi"))
    # a place that a range holds has a later end of its key, the one with the next number
    won = _won(ends, whole, keys, "lo", value, seq).join(follower, "_qf_n")
    return won.select(*keys, "lo", "hi", f"w.{seq}", f"w.{value}")


def as_of(rows: DataFrame, at: str, steps: DataFrame, step_at: str, keys: list[str], name: str = "step") -> DataFrame:
    """``rows`` with ``name``: a struct of the columns of the step with the greatest ``step_at`` up to ``at``, of equal keys.

    Both are dealt together into ranges of (keys, place); a window fills in within a range, and what a key's earlier
    ranges end with is one row a range. So a key may hold any share of the rows. Steps are different in keys and place.
    """
    columns = [c for c in steps.columns if c not in keys]
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_qf_row")
    left = rows.select(*keys, F.col(at).cast("long").alias("_qf_at"), F.lit(1).alias("_qf_side"), own, F.lit(None).cast(steps.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_qf_step"))
    right = steps.select(*keys, F.col(step_at).cast("long").alias("_qf_at"), F.lit(0).alias("_qf_side"), F.lit(None).cast(left.schema["_qf_row"].dataType).alias("_qf_row"), F.struct(*columns).alias("_qf_step"))
    both = stored(left.union(right).repartitionByRange(*keys, "_qf_at", "_qf_side", F.xxhash64("_qf_row")).withColumn(PART, F.spark_partition_id()), "as_of")
    within = Window.partitionBy(*keys, PART).orderBy("_qf_at", "_qf_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_qf_in", F.last("_qf_step", ignorenulls=True).over(within)).where("_qf_side = 1")
    ends = both.groupBy(*keys, PART).agg(F.max_by(F.col("_qf_step"), F.when(F.col("_qf_side") == 0, F.col("_qf_at"))).alias("end"))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_qf_before", F.last("end", ignorenulls=True).over(earlier))
    same = filled[PART] == F.col("_qf_p")
    for k in keys:
        same = same & filled[k].eqNullSafe(F.col(f"_qf_{k}"))
    joined = filled.join(ends.select(*[F.col(k).alias(f"_qf_{k}") for k in keys], F.col(PART).alias("_qf_p"), "_qf_before"), same, "left")
    return joined.select("_qf_row.*", F.coalesce("_qf_in", "_qf_before").alias(name))


def in_last_range(rows: DataFrame, code: str, ranges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value``: what the last range that holds the code says, null if there is none.

    The different codes are the points that ranges are cut at, so ranges between two codes cost a row.
    """
    at = rows.select(*keys, F.col(code).cast("long").alias("_qf_code")).where("_qf_code IS NOT NULL").distinct()
    won = _won(stored(_numbered(at, keys, "_qf_code"), "codes"), ranges, keys, "_qf_code", value, "seq")
    same = F.col(f"`{code}`").cast("long") == F.col("_qf_code")
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"_qf_k_{k}"))
    won = won.select(*[F.col(k).alias(f"_qf_k_{k}") for k in keys], "_qf_code", F.col(f"w.{value}").alias("_qf_value"))
    return rows.join(won, same, "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_qf_value").alias(value))


# --- boxes -----------------------------------------------------------------------------------------------------------


def overlapping(boxes: DataFrame, keys: list[str], box: str = "box", ident: str = "id", hot: int = 2000) -> DataFrame:
    """keys, a, b: each pair of boxes (struct<x,y,width,height>) of equal keys that share more than an edge, a < b.

    A grid for each size: a box lies in at most four cells of the grid whose cells are just wider than itself, and in
    at most four of each coarser one. A pair meets in the coarser of its two grids, in the cell that holds the lower left
    corner of what they share, so it is met once. Cells with more than ``hot`` boxes of their own size are dealt out to
    several tasks. ``ident`` tells boxes apart; keys that are null, boxes with nulls and negative sizes meet nothing.
    """
    x, y, w, h = (F.col(f"{box}.{c}").cast("double") for c in ("x", "y", "width", "height"))
    fine = F.coalesce((w >= 0) & (h >= 0) & (F.abs(x) + F.abs(y) + w + h < float("inf")), F.lit(False))
    level = F.when(F.greatest(w, h) > 0, F.ceil(F.log2(F.greatest(w, h))).cast("int")).otherwise(-1000)
    rows = boxes.where(fine).select(*keys, F.col(ident).alias("id"), F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")).alias("r"), F.greatest(level, F.lit(-40)).alias("level"))
    rows = stored(rows, "boxes")
    levels = sorted(r[0] for r in rows.select("level").distinct().collect())  # at most a thousand, some twenty as a rule
    if not levels:
        return rows.select(*keys, F.col("id").alias("a"), F.col("id").alias("b"))

    def cells(df: DataFrame, which: Column) -> DataFrame:
        side = F.pow(F.lit(2.0), which)
        at = lambda v: F.floor(v / side)
        span = lambda v, far: F.sequence(at(v), at(v + far))
        df = df.withColumn("side", side).withColumn("cx", F.explode(span(F.col("r.x"), F.col("r.width")))).withColumn("cy", F.explode(span(F.col("r.y"), F.col("r.height"))))
        return df

    own = cells(rows.withColumn("grid", F.col("level")), F.col("level"))
    up = cells(rows.withColumn("grid", F.explode(F.array(*[F.lit(n) for n in levels]))).where("grid >= level"), F.col("grid"))
    cell = [*keys, "grid", "cx", "cy"]
    crowded = own.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*cell, F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    crowded = stored(crowded, "crowded")
    deal = lambda df: df.join(crowded, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    big = deal(own).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    small = deal(up).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    small = small.select(*[F.col(c).alias(f"_{c}") for c in [*cell, "part"]], F.col("id").alias("_id"), F.col("r").alias("_r"), F.col("level").alias("_level"))
    same = F.lit(True)
    for c in [*cell, "part"]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    # of two boxes of one size the greater id is the one that comes to the other's cell
    once = (F.col("_level") < F.col("level")) | (F.col("id") < F.col("_id"))
    r, s = F.col("r"), F.col("_r")
    corner = (F.floor(F.greatest(r["x"], s["x"]) / F.col("side")) == F.col("cx")) & (F.floor(F.greatest(r["y"], s["y"]) / F.col("side")) == F.col("cy"))
    met = big.join(small, same).where(once & (F.col("id") != F.col("_id")) & geometry.overlap(r, s) & corner)
    return met.select(*keys, F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"))
