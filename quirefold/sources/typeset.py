"""Page content from plain text: a source of realistic streams whose size follows the text tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fonts of typeset pages: F1 for lines of Latin text, F2 with four-byte codes (UTF-32) for all others.
FONT = json.dumps({"base": "Helvetica", "encoding": "cp1252"})
#: Characters that F1 shows as they are.
LATIN = r"^[\x00-\x7f\xa0-\xff]*$"


def _program(ranges: list[str], kind: str) -> str:
    return "begincmap\n1 begincodespacerange\n<00000000> <0010FFFF>\nendcodespacerange\n" + "".join(f"1 begin{kind}range\n{r}\nend{kind}range\n" for r in ranges) + "endcmap\n"


def wide_font() -> str:
    """A composite font whose codes are code points; its own map gives codes and character identifiers, another one the text."""
    planes = ["<00000000> <0000D7FF> <0000>", "<0000E000> <0000FFFF> <E000>"]
    # beyond the first plane the text is a pair of surrogates, of which a range may only count the second
    pairs = [f"<{c:08X}> <{c + 1023:08X}> <{0xD800 + ((c - 0x10000) >> 10):04X}DC00>" for c in range(0x10000, 0x20000, 1024)]
    cids = ["<00000000> <0000FFFF> 0", "<00010000> <0001FFFF> 65536"]
    return json.dumps({"base": "Wide", "type0": True, "cmap": _program(cids, "cid").encode().hex(), "to_unicode": _program(planes + pairs, "bf").encode().hex(), "default_width": 600})


WIDE_FONT = wide_font()


#: Characters beyond the first two planes.
FAR = r"[\x{20000}-\x{10FFFF}]"


def far_font(lines: Column) -> Column:
    """The specification of a composite font that has the characters of ``lines``, whatever their plane, by code point."""
    chars = F.array_distinct(F.filter(F.split(F.array_join(lines, ""), ""), lambda c: c != ""))
    entry = lambda c: F.concat(F.lit("<"), F.hex(F.encode(c, "UTF-32")), F.lit("> <"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">"))
    space = "begincmap\n1 begincodespacerange\n<00000000> <0010FFFF>\nendcodespacerange\n"
    program = F.concat(F.lit(space), F.size(chars).cast("string"), F.lit(" beginbfchar\n"), F.array_join(F.transform(chars, entry), "\n"), F.lit("\nendbfchar\nendcmap\n"))
    head = json.dumps({"base": "Far", "type0": True, "default_width": 600, "cmap": (space + "endcmap\n").encode().hex(), "to_unicode": ""})
    return F.concat(F.lit(head[:-2]), F.hex(F.encode(program, "ISO-8859-1")), F.lit('"}'))


def literal(text: Column) -> Column:
    """A string token: parentheses, backslashes and carriage returns escaped."""
    return F.concat(F.lit("("), F.regexp_replace(F.regexp_replace(text, r"([()\\])", r"\\$1"), "\r", r"\\r"), F.lit(")"))


def typeset(texts: DataFrame, key: str = "doc_id", text: str = "text", size: int = 12, leading: int = 12) -> DataFrame:
    """One page per row, one show operator per line: doc_id, page_index, content, fonts.

    Null text gives an empty page. Lines with characters outside Latin-1 are set in a composite font, whose codes are the
    first two planes of Unicode; lines with characters beyond those in a font of the page's own, which has what they need.
    """
    known = F.col(text)
    split = F.split(known, "\n")
    shows = lambda x, font: F.concat(F.lit(f"/{font} {size} Tf\n<"), F.hex(F.encode(x, "UTF-32")), F.lit(f"> Tj\n/F1 {size} Tf"))
    line = lambda x: F.when(x.rlike(LATIN), F.concat(literal(x), F.lit(" Tj"))).when(x.rlike(FAR), shows(x, "F3")).otherwise(shows(x, "F2"))
    shown = F.array_join(F.transform(split, line), f"\n0 -{leading} Td\n")
    content = F.concat(F.lit(f"BT\n/F1 {size} Tf\n72 720 Td\n"), shown, F.lit("\nET\n"))
    plain = F.create_map(F.lit("F1"), F.lit(FONT))
    wide = F.create_map(F.lit("F1"), F.lit(FONT), F.lit("F2"), F.lit(WIDE_FONT))
    far = F.create_map(F.lit("F1"), F.lit(FONT), F.lit("F2"), F.lit(WIDE_FONT), F.lit("F3"), far_font(F.filter(split, lambda x: x.rlike(FAR))))
    fonts = F.when(F.coalesce(known, F.lit("")).rlike(r"(?s)" + LATIN), plain).when(known.rlike(FAR), far).otherwise(wide)
    return texts.select(F.col(key).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), F.encode(F.coalesce(content, F.lit("")), "ISO-8859-1").alias("content"), fonts.alias("fonts"))
