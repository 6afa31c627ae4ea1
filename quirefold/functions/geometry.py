"""Affine matrices, rectangles and rotations as column expressions over structs of doubles.

A matrix is struct<a,b,c,d,e,f> for row vectors; ``mul(m, n)`` applies m first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = "abcdef"


def matrix(*values: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for v, n in zip(values, NAMES)])


def mul(m: Column, n: Column) -> Column:
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    """struct<x,y> of a transformed point."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def apply_vector(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y).alias("x"), (m["b"] * x + m["d"] * y).alias("y"))


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def invert(m: Column) -> Column:
    """Null if the matrix has no inverse."""
    d = determinant(m)
    inverse = matrix(m["d"] / d, -m["b"] / d, -m["c"] / d, m["a"] / d, (m["c"] * m["f"] - m["d"] * m["e"]) / d, (m["b"] * m["e"] - m["a"] * m["f"]) / d)
    return F.when(d != 0, inverse)


def decompose(m: Column) -> Column:
    """struct<scale_x,scale_y,rotation,flipped>: lengths along the axes, the angle of the x axis."""
    sx = F.hypot(m["a"], m["b"])
    return F.struct(sx.alias("scale_x"), F.when(sx == 0, F.hypot(m["c"], m["d"])).otherwise(F.abs(determinant(m)) / sx).alias("scale_y"), F.atan2(m["b"], m["a"]).alias("rotation"), (determinant(m) < 0).alias("flipped"))


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct<x,y,width,height> from any two opposite corners."""
    x, y = F.least(x0, x1), F.least(y0, y1)
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(x0, x1) - x).alias("width"), (F.greatest(y0, y1) - y).alias("height"))


def overlap(r: Column, s: Column) -> Column:
    """True if two rectangles share more than an edge."""
    return (r["x"] < s["x"] + s["width"]) & (s["x"] < r["x"] + r["width"]) & (r["y"] < s["y"] + s["height"]) & (s["y"] < r["y"] + r["height"])


def intersect_rect(r: Column, s: Column) -> Column:
    """What two rectangles share, or null if that is no more than an edge."""
    x, y = F.greatest(r["x"], s["x"]), F.greatest(r["y"], s["y"])
    return F.when(overlap(r, s), rect(x, y, F.least(r["x"] + r["width"], s["x"] + s["width"]), F.least(r["y"] + r["height"], s["y"] + s["height"])))


def transformed_box(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct<x,y,width,height>: the upright box around a transformed box."""
    corners = [apply(m, x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def union_rect(r: Column, s: Column) -> Column:
    """The smallest rectangle around two."""
    return rect(F.least(r["x"], s["x"]), F.least(r["y"], s["y"]), F.greatest(r["x"] + r["width"], s["x"] + s["width"]), F.greatest(r["y"] + r["height"], s["y"] + s["height"]))


def baseline_ratio(ascent: Column, descent: Column) -> Column:
    """How far below the top of a line its baseline is, as a share of the size; both in em, half of the leading above."""
    return (1 - (ascent + descent)) / 2 + ascent


def to_screen(rotation: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct<x,y> of a page point on a y-down screen for a page turned by 0, 90, 180 or 270 degrees."""
    sx = F.when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, height - y).otherwise(x)
    sy = F.when(rotation == 90, x).when(rotation == 180, y).when(rotation == 270, width - x).otherwise(height - y)
    return F.struct(sx.alias("x"), sy.alias("y"))


def quarter_turns(degrees: Column) -> Column:
    """A /Rotate value rounded to a quarter turn, 0 to 270; halves round up."""
    return F.pmod(F.floor(F.coalesce(degrees, F.lit(0)) / 90 + 0.5).cast("int") * 90, F.lit(360))


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def number_text(x: Column) -> Column:
    """At most six decimals, no exponent, no trailing zeros, no negative zero; non-finite is 0."""
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", finite), r"0+$", ""), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def hex_text(data: Column) -> Column:
    """A hexadecimal string token of binary data."""
    return F.concat(F.lit("<"), F.hex(data), F.lit(">"))


def to_rgb(family: Column, parts: Column) -> Column:
    """struct<r,g,b> of colour components, or null for an unknown space.

    Gray, RGB, CMYK as (1-c)(1-k), and tints (Separation, DeviceN) as inverted gray.
    """
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(0.0))
    rgb = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    gray, tint = at(0), 1 - at(0)
    cmyk = [(1 - at(k)) * (1 - at(3)) for k in range(3)]
    return F.when(family == "gray", rgb(gray, gray, gray)).when(family == "rgb", rgb(at(0), at(1), at(2))).when(family == "cmyk", rgb(*cmyk)).when(family == "tint", rgb(tint, tint, tint))
