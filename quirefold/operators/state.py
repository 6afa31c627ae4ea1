"""State in force under save and restore, as windows: no row sees more of its stream than Spark's running aggregates.

Rows of a stream (``keys``) in the order of ``seq`` open and close scopes; a value that is set holds until it is set again
in the same scope or its scope is closed, which brings back what the enclosing scope had. No recursion is needed:

* The level is the running sum of openings and closings, held at 0: a closing without an opening has no effect.
* A row's scope is the last opening that reached the row's own level.
* A value's depth is the number of open scopes that have set it. It rises with the first setting in a scope and falls
  when such a scope is closed, so what is in force is the last setting that reached the row's own depth; whatever
  closed scopes have set in between lies deeper.

Transformations add up instead of replacing each other. Each has a predecessor, the one in force right before it, and
products along these chains are made by pointer doubling: joins of transformations only, as many rounds as the logarithm
of the longest chain.

All windows share their partitioning, so a stream is shuffled once and sorted a few times; running aggregates spill. A
stream (a page, a session) is a task's.

Defined results: rows with equal ``seq`` are taken in any order; null keys are a stream of their own; no rows, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import geometry
from quirefold.operators.stored import stored


def scopes(rows: DataFrame, keys: list[str], seq: str, opens: Column, closes: Column) -> DataFrame:
    """``rows`` with level (after the row), scope (seq of the row that opened it, null outside), closes (whether the row
    closes a scope) and inside (the scope that the row closes, or else its own)."""
    order = Window.partitionBy(*keys).orderBy(seq)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.coalesce(opens, F.lit(False)), F.coalesce(closes, F.lit(False))
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    rows = rows.withColumn("_qf_open", F.when(opens, F.col(seq))).withColumn("closes", closes).withColumn("_qf_sum", F.sum(step).over(upto))
    rows = rows.withColumn("level", F.col("_qf_sum") - F.least(F.lit(0), F.min("_qf_sum").over(upto)))
    peers = Window.partitionBy(*keys, "level").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.last("_qf_open", ignorenulls=True).over(peers))
    before = F.lag("scope").over(order)
    rows = rows.withColumn("_qf_before", before).withColumn("closes", F.col("closes") & F.col("_qf_before").isNotNull())
    return rows.withColumn("inside", F.when(F.col("closes"), F.col("_qf_before")).otherwise(F.col("scope"))).drop("_qf_open", "_qf_sum", "_qf_before")


def in_scope(rows: DataFrame, keys: list[str], seq: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` of ``scopes`` with each of ``values`` as it is in force after the row; null is no setting."""
    names = list(values)
    rows = rows.select("*", *[v.alias(f"_qf_v{i}") for i, v in enumerate(values.values())])
    within = Window.partitionBy(*keys, "inside").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.count(f"_qf_v{i}").over(within).alias(f"_qf_n{i}") for i in range(len(names))])
    upto = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)

    def step(i: int) -> Column:
        first = F.col(f"_qf_v{i}").isNotNull() & (F.col(f"_qf_n{i}") == 1)
        return F.when(first, 1).when(F.col("closes") & (F.col(f"_qf_n{i}") > 0), -1).otherwise(0)

    rows = rows.select("*", *[F.sum(step(i)).over(upto).alias(f"_qf_d{i}") for i in range(len(names))])
    for i, name in enumerate(names):
        peers = Window.partitionBy(*keys, f"_qf_d{i}").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"_qf_f{i}", F.last(f"_qf_v{i}", ignorenulls=True).over(peers))
    kept = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("_qf_") and c not in names]
    return rows.select(*kept, *[F.col(f"_qf_f{i}").alias(n) for i, n in enumerate(names)])


def products(links: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """keys, seq, product: each row's matrix times those of all its predecessors, itself first. links: keys, seq, prev, m.

    Rounds of pointer doubling; only whether any row is still on its way reaches the driver.
    """
    now = stored(links.select(*keys, seq, "prev", F.col("m").alias("product")), "products")
    while not now.where("prev is not null").isEmpty():
        to = now.select(*[F.col(k).alias(f"_qf_{k}") for k in keys], F.col(seq).alias("_qf_seq"), F.col("prev").alias("_qf_prev"), F.col("product").alias("_qf_m"))
        same = F.col("prev") == F.col("_qf_seq")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_qf_{k}"))
        moved = now.join(to, same, "left")
        product = F.when(F.col("_qf_m").isNull(), F.col("product")).otherwise(geometry.mul(F.col("product"), F.col("_qf_m")))
        now = stored(moved.select(*keys, seq, F.col("_qf_prev").alias("prev"), product.alias("product")), "products")
    return now.select(*keys, seq, "product")


def transformed(rows: DataFrame, keys: list[str], seq: str, m: Column, name: str = "ctm") -> DataFrame:
    """``rows`` of ``scopes`` with the product of all transformations in force after the row: struct<a,b,c,d,e,f>.

    ``m`` is a row's own transformation (applied before those in force) or null.
    """
    rows = rows.withColumn("_qf_m", m)
    rows = in_scope(rows.withColumnRenamed("_qf_m", "own_m"), keys, seq, {"last_m": F.when(F.col("own_m").isNotNull(), F.col(seq))})
    rows = stored(rows.withColumn("prev", F.lag("last_m").over(Window.partitionBy(*keys).orderBy(seq))), "transformations")
    made = products(rows.where("own_m is not null").withColumnRenamed("own_m", "m"), keys, seq)
    to = made.select(*[F.col(k).alias(f"_qf_{k}") for k in keys], F.col(seq).alias("_qf_seq"), F.col("product").alias("_qf_p"))
    same = F.col("last_m") == F.col("_qf_seq")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_qf_{k}"))
    one = geometry.matrix(1, 0, 0, 1, 0, 0)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("own_m", "last_m", "prev", name)]
    return rows.join(to, same, "left").select(*kept, F.coalesce("_qf_p", one).alias(name))


# --- the state of page operators -------------------------------------------------------------------------------------

KEYS, SEQ = ["doc_id", "page_index"], "op_seq"
#: Colour spaces that need no resource, and their families.
FAMILIES = {"DeviceGray": "gray", "G": "gray", "CalGray": "gray", "DeviceRGB": "rgb", "RGB": "rgb", "CalRGB": "rgb", "Lab": "rgb", "DeviceCMYK": "cmyk", "CMYK": "cmyk"}


def _fill(space: Column, nums: Column) -> Column:
    """array of red, green, blue, or null: components as the space has them, an unknown space by their number."""
    parts = F.transform(nums, lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    n = F.size(parts)
    wanted = F.when(space == "gray", 1).when(space == "rgb", 3).when(space == "cmyk", 4).otherwise(n)
    family = F.when(wanted == 1, "gray").when(wanted == 3, "rgb").when(wanted == 4, "cmyk")
    colour = geometry.to_rgb(family, parts)
    tint = 1 - F.element_at(parts, -1)
    plain = F.when((n >= wanted) & colour.isNotNull(), F.array(colour["r"], colour["g"], colour["b"]))
    return F.when((space == "tint") & (n > 0), F.array(tint, tint, tint)).otherwise(plain)


def text_states(operators: DataFrame) -> DataFrame:
    """One row per operator that shows a string inside a text object, with the state in force there.

    ``operators``: rows as of ``interpret.operators``, and if there are any ``spaces`` (map of a page's colour spaces to
    their families) and ``states`` (of its graphics states that set a font, as ``sources.pdf.pages`` has them). Result: doc_id, page_index, op_seq, start, end, op, font_name, font_size, char_spacing, word_spacing,
    horiz_scale, leading, rise, render_mode, fill, stroke, line_width, ctm and line_matrix (both struct<a..f>; the matrix of the line's
    start: what a show before it on the same line has advanced is not in it).
    """
    op, nums = F.col("op"), F.coalesce(F.col("nums"), F.array().cast("array<double>"))
    num = lambda k: F.coalesce(F.get(nums, F.lit(k)), F.lit(0.0))
    upto = Window.partitionBy(*KEYS).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    spaces = F.col("spaces") if "spaces" in operators.columns else F.lit(None).cast("map<string,string>")
    states = F.col("states") if "states" in operators.columns else F.lit(None).cast("map<string,struct<size:double,named:boolean>>")
    rows = operators.select(*KEYS, SEQ, "start", "end", "op", nums.alias("nums"), "name", (F.size("strings") > 0).alias("shows"), spaces.alias("spaces"), F.when(op == "gs", F.try_element_at(states, F.col("name"))).alias("gs"))
    rows = rows.withColumn("in_text", F.coalesce(F.last(F.when(op == "BT", True).when(op == "ET", False), ignorenulls=True).over(upto), F.lit(False)))
    quoted, double = F.col("in_text") & op.isin("'", '"'), F.col("in_text") & (op == '"')
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    space_of = lambda gray, rgb, cmyk, named: F.when(op == gray, "gray").when(op == rgb, "rgb").when(op == cmyk, "cmyk").when(op == named, F.coalesce(F.try_element_at(known, F.col("name")), F.try_element_at(F.col("spaces"), F.col("name")), F.lit("unknown")))
    rows = scopes(rows, KEYS, SEQ, op == "q", op == "Q")
    rows = in_scope(rows, KEYS, SEQ, {
        "space": space_of("g", "rg", "k", "cs"), "stroke_space": space_of("G", "RG", "K", "CS"), "line_width": F.when(op == "w", num(0)), "font_name": F.when(op == "Tf", F.coalesce("name", F.lit(""))).when(F.col("gs.named"), F.concat(F.lit("gs:"), F.col("name"))), "font_size": F.when(op == "Tf", num(0)).otherwise(F.col("gs.size")), "char_spacing": F.when(double, num(1)).when(op == "Tc", num(0)), "word_spacing": F.when(double | (op == "Tw"), num(0)),
        "horiz_scale": F.when(op == "Tz", num(0) / 100), "leading": F.when(op == "TL", num(0)).when(op == "TD", -num(1)), "rise": F.when(op == "Ts", num(0)), "render_mode": F.when(op == "Tr", num(0).cast("int")),
    })
    drawn = F.when(op.isin("g", "rg", "k"), F.struct(_fill(F.col("space"), F.col("nums")).alias("rgb")))
    drawn = drawn.when(op.isin("sc", "scn"), F.struct(F.when(F.coalesce("name", F.lit("")) == "", _fill(F.coalesce("space", F.lit("gray")), F.col("nums"))).alias("rgb")))
    pen_space, parts = F.coalesce("stroke_space", F.lit("gray")), F.size("nums")
    stroked = F.when(op.isin("G", "RG", "K") | (op.isin("SC", "SCN") & ((parts > 0) | (pen_space == "unknown"))), F.struct(F.when(op.isin("G", "RG", "K") | (parts > 0), _fill(pen_space, F.col("nums"))).alias("rgb")))
    rows = in_scope(rows, KEYS, SEQ, {"fill": drawn, "stroke": stroked})
    # the line's matrix isn't saved: the last matrix that was set, moved by all steps since
    lead = F.coalesce("leading", F.lit(0.0))
    base = F.when(op == "BT", geometry.matrix(1, 0, 0, 1, 0, 0)).when(op == "Tm", geometry.matrix(*[num(k) for k in range(6)]))
    dx = F.when(op.isin("Td", "TD"), num(0)).otherwise(0.0)
    dy = F.when(op.isin("Td", "TD"), num(1)).when((op == "T*") | quoted, -lead).otherwise(0.0)
    rows = rows.withColumn("_base", base).withColumn("dx", dx).withColumn("dy", dy).withColumn("line", F.count("_base").over(upto)).withColumn("_base", F.last("_base", ignorenulls=True).over(upto))
    since = Window.partitionBy(*KEYS, "line").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("dx", F.sum("dx").over(since)).withColumn("dy", F.sum("dy").over(since))
    at = F.coalesce("_base", geometry.matrix(1, 0, 0, 1, 0, 0))
    step = geometry.matrix(1, 0, 0, 1, F.col("dx"), F.col("dy"))
    rows = transformed(rows.withColumn("line_matrix", geometry.mul(step, at)), KEYS, SEQ, F.when(op == "cm", geometry.matrix(*[num(k) for k in range(6)])))
    rows = rows.where(F.col("in_text") & F.col("shows") & op.isin("Tj", "TJ", "'", '"'))
    black = F.array(*[F.lit(0.0)] * 3)
    number = lambda c, d=0.0: F.coalesce(c, F.lit(d)).alias(c)
    return rows.select(
        *KEYS, SEQ, "start", "end", "op", F.coalesce("font_name", F.lit("")).alias("font_name"), number("font_size"), number("char_spacing"), number("word_spacing"),
        number("horiz_scale", 1.0), number("leading"), number("rise"), number("render_mode", 0), F.when(F.col("fill").isNull(), black).otherwise(F.col("fill.rgb")).alias("fill"), F.when(F.col("stroke").isNull(), black).otherwise(F.col("stroke.rgb")).alias("stroke"), number("line_width", 1.0), "ctm", "line_matrix",
    )
