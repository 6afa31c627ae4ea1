"""Facts about runs, lines, pages and streams: what dominates, what encloses, what is shared, repeated, locked or lost.

All are partial aggregates, joins or windows over columns that the caller names, so no group is gathered in a task
unless its own result is as long as the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.ranges import in_last_range

#: Largest mean deviation of samples that still count as one flat colour; warnings from worst to mildest.
FLAT, LEVELS = 10.0, ("error", "warn", "info")
#: Fixed value: deepest nesting of forms.
DEPTH = 8


def dominant(df: DataFrame, keys: list[str], weight: str, ties: list[str], values: list[str]) -> DataFrame:
    """``values`` and the weight of the heaviest row of each key, the first one by the whole-number ``ties``."""
    best = F.max(F.struct(weight, *[(-F.col(t)).alias(f"_{i}") for i, t in enumerate(ties)], *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])).alias("_m")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_m.v{i}").alias(v) for i, v in enumerate(values)], F.col(f"_m.{weight}").alias(weight))


def enclosing(df: DataFrame, keys: list[str], x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """The box around all boxes of each key: x0, y0, x1, y1."""
    return df.groupBy(*keys).agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


def largest_page(pages: DataFrame, keys: list[str], width: str = "display_width", height: str = "display_height") -> DataFrame:
    return pages.groupBy(*keys).agg(F.max(width).alias("max_width"), F.max(height).alias("max_height"))


def spaced_pieces(parts: Column, text, apart) -> Column:
    """Texts of an array of parts, a blank behind each that stands ``apart`` from the next and has none there yet.

    ``text(part)`` is a part's text, ``apart(part, next)`` the condition.
    """

    def piece(part: Column, i: Column) -> Column:
        following = F.get(parts, i + 1)
        bare = following.isNotNull() & ~text(part).endswith(" ") & ~text(following).startswith(" ")
        return F.when(bare & apart(part, following), F.concat(text(part), F.lit(" "))).otherwise(text(part))

    return F.transform(parts, piece)


def assembled(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """text and n_parts of each key: the parts in order, a blank between two unless one is there."""
    parts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("text")))).alias("_p"))
    pieces = spaced_pieces(F.col("_p"), lambda p: p["text"], lambda p, q: F.lit(True))
    return parts.select(*keys, F.array_join(pieces, "").alias("text"), F.size("_p").cast("long").alias("n_parts"))


def shared(uses: DataFrame, item: list[str], owner: str) -> DataFrame:
    """item, n_owners of what several owners use."""
    return uses.groupBy(*item).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")


def repeated(df: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """keys, n, first_owner of what occurs twice or more."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(owner).alias("first_owner")).where("n > 1")


def deviations(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, deviation (sum of distances from it), n and flat per key: medians are joined back, nothing is gathered."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    joined = df.join(middle, keys)
    found = joined.groupBy(*keys, "median").agg(F.sum(F.abs(F.col(value) - F.col("median"))).alias("deviation"), F.count("*").alias("n"))
    return found.withColumn("flat", F.col("deviation") / F.col("n") <= FLAT)


def by_severity(df: DataFrame, keys: list[str], level: Column) -> DataFrame:
    """errors, warnings, infos and worst (1 to 3) per key; ``level`` is one of LEVELS."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
    return df.groupBy(*keys).agg(F.count_if(level == "error").alias("errors"), F.count_if(level == "warn").alias("warnings"), F.count_if(level == "info").alias("infos"), F.min(F.when(rank > 0, rank)).alias("worst"))


def in_severity_order(df: DataFrame, keys: list[str], level: Column, order: list[str]) -> DataFrame:
    """``df`` with position: the worst first, then in order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, *order)))


def any_and_all(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """some, every and n per key."""
    return df.groupBy(*keys).agg(F.bool_or(condition).alias("some"), F.bool_and(condition).alias("every"), F.count("*").alias("n"))


def first_seen(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, value, position: each different value once, numbered in the order in which it first occurs."""
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).drop("_first")


def multiset_difference(left: DataFrame, right: DataFrame, value: Column) -> DataFrame:
    """value, n: how often each value is in ``left`` beyond its number in ``right``."""
    return left.select(value).exceptAll(right.select(value)).groupBy(*left.select(value).columns).agg(F.count("*").alias("n"))


def unlocked(items: DataFrame, locks: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a lock."""
    return items.join(locks, keys, "left_anti")


def edited_runs(edits: DataFrame, lines: DataFrame, runs: DataFrame, fonts: DataFrame, line: list[str], run: list[str], font: list[str]) -> DataFrame:
    """Edits with the runs of their lines and, where there is one, the font of each run; unknown lines and runs drop out."""
    return edits.join(lines, line).join(runs, [*line, *[c for c in run if c not in line]] if run else line).join(fonts, font, "left")


def own_or_other(rows: DataFrame, own: tuple[DataFrame, Column], other: tuple[DataFrame, Column], value: str, name: str, default: str) -> DataFrame:
    """``rows`` with the value of their own stream if there is one, else of the other, else the default."""
    joined = rows.join(own[0].withColumnRenamed(value, "_own"), own[1], "left").join(other[0].withColumnRenamed(value, "_other"), other[1], "left")
    return joined.withColumn(name, F.coalesce("_own", "_other", F.lit(default)))


def last_range(codes: DataFrame, code: str, ranges: DataFrame, default: int) -> DataFrame:
    """``codes`` with width: that of the last range (lo, hi, width, seq) that holds the code, else the default.

    Ranges of any width: they are cut into disjoint ones, and each code looks for the one that begins last before it.
    """
    found = in_last_range(codes, code, ranges, [], "width")
    return found.withColumn("width", F.coalesce("width", F.lit(default)).cast("long"))


def inherited(roots: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """kind, id, value, depth of a tree of fixed height: what a root says holds below. roots: kind, id, value;
    each level: kind, id, up (the id of its parent on the level before), one equi-join a level."""
    found = above = roots.select("kind", "id", "value", F.lit(0).cast("long").alias("depth"))
    for depth, level in enumerate(levels, 1):
        above = level.join(above.select(F.col("id").alias("up"), "value"), "up").select("kind", "id", "value", F.lit(depth).cast("long").alias("depth"))
        found = found.union(above)
    return found


def flattened(roots: DataFrame, uses: DataFrame, depth: int = DEPTH) -> DataFrame:
    """root, id, depth, path: everything that a root shows, through nested uses (up, id), one join a level.

    A use inside itself is left out; ``depth`` is the deepest nesting.
    """
    found = level = roots.select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("depth"), F.array("id").alias("path"))
    for k in range(1, depth + 1):
        deeper = level.select("root", F.col("id").alias("up"), "path").join(uses.select("up", "id"), "up")
        level = deeper.where(~F.array_contains("path", F.col("id"))).select("root", "id", F.lit(k).cast("long").alias("depth"), F.array_append("path", F.col("id")).alias("path"))
        found = found.union(level)
    return found


def touched(*parts: DataFrame, still_used: DataFrame, key: str) -> DataFrame:
    """Keys of any part that nothing still uses."""
    either = parts[0].select(key)
    for p in parts[1:]:
        either = either.union(p.select(key))
    return either.distinct().join(still_used.select(key).distinct(), key, "left_anti")


def outside(texts: DataFrame, text: str, known: str) -> DataFrame:
    """ch, n: characters that a repertoire (a character class of a regular expression) lacks, and how often."""
    chars = texts.select(F.explode(F.split(F.regexp_replace(text, f"[{known}]", ""), "")).alias("ch"))
    return chars.where("ch != ''").groupBy("ch").agg(F.count("*").alias("n"))


#: The zoom levels in percent, and the bounds of a scale.
ZOOM, SMALLEST, LARGEST = (25, 50, 75, 100, 150, 200, 400), 0.1, 8.0


def zoom_steps(percent: Column) -> Column:
    """struct<up,down>: the next level above and below, null beyond the last."""
    levels = F.array(*[F.lit(z) for z in ZOOM])
    return F.struct(F.array_min(F.filter(levels, lambda z: z > percent)).alias("up"), F.array_max(F.filter(levels, lambda z: z < percent)).alias("down"))


def zoom_scale(mode: Column, room_width: Column, room_height: Column, width: Column, height: Column) -> Column:
    """The scale that fits a page's width, or the whole page, into a room; within bounds."""
    across, down = room_width / width, room_height / height
    wanted = F.when(mode == "width", across).when(mode == "page", F.least(across, down)).otherwise(F.lit(1.0))
    return F.least(F.lit(LARGEST), F.greatest(F.lit(SMALLEST), wanted))
