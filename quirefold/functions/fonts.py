"""Font facts as fixed values and rules: widths of two standard faces, style by name, subset tags, text folds."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths of Helvetica for character codes 32 to 126, in thousandths of an em.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
#: Helvetica's letters that are no base letter with an accent.
HELVETICA_OTHER = {"ß": 611, "æ": 889, "Æ": 1000, "ø": 611, "Ø": 778, "ì": 278, "í": 278, "î": 278, "ï": 278, "ð": 556, "þ": 556, "Ð": 722, "Þ": 667, "¡": 333, "¿": 611, "«": 556, "»": 556, "©": 737, "®": 737, "°": 400, "·": 278, "–": 556, "—": 1000, "‘": 222, "’": 222, "“": 333, "”": 333, "•": 350, "…": 1000, "€": 556}
#: Advance widths of Helvetica-Bold and the four Times faces for character codes 32 to 126.
OTHER_FACES = {
    "Helvetica-Bold": (
        278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
        975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
        333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
    ),
    "Times-Roman": (
        250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
        921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
        333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
    ),
    "Times-Italic": (
        250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 675, 675, 675, 500,
        920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833, 667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500,
        333, 500, 500, 444, 500, 444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400, 275, 400, 541,
    ),
    "Times-BoldItalic": (
        250, 389, 555, 500, 500, 833, 778, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500,
        832, 667, 667, 667, 722, 667, 667, 722, 778, 389, 500, 667, 611, 889, 722, 722, 611, 722, 667, 556, 611, 722, 667, 889, 667, 611, 611, 333, 278, 333, 570, 500,
        333, 500, 500, 444, 500, 444, 333, 500, 556, 278, 278, 500, 278, 778, 556, 500, 500, 500, 389, 389, 278, 556, 444, 667, 500, 444, 389, 348, 220, 348, 570,
    ),
    "Times-Bold": (
        250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500,
        930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500,
        333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520,
    ),
}
ASCENT = {"Helvetica": 0.718, "Helvetica-Bold": 0.718, "Courier": 0.629, "Times-Roman": 0.683, "Times-Bold": 0.683, "Times-Italic": 0.683, "Times-BoldItalic": 0.683}
DESCENT = {"Helvetica": -0.207, "Helvetica-Bold": -0.207, "Courier": -0.157, "Times-Roman": -0.217, "Times-Bold": -0.217, "Times-Italic": -0.217, "Times-BoldItalic": -0.217}
#: Width of a glyph that the face doesn't have.
DEFAULT_WIDTH = 500
#: The standard encoding where it differs from ASCII; two strings of codes and characters each.
STANDARD = {39: "’", 96: "‘"} | dict(zip([*range(161, 176), *range(177, 181), *range(182, 190), 191, *range(193, 201), 202, 203, *range(205, 209), 225, 227, *range(232, 236), 241, 245, *range(248, 252)], "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß"))
#: The symbol encoding where it differs from ASCII.
SYMBOL = (
    dict(zip([34, 36, 39, 42, 45, 64, 92, 94], "∀∃∋∗−≅∴⊥")) | dict(zip(range(65, 91), "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ")) | dict(zip(range(97, 123), "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"))
    | dict(zip([163, 165, *range(171, 178), 179, 180, *range(182, 189), 206, 213, 214, 229, 242], "≤∞↔←↑→↓°±≥×∂•÷≠≡≈…∈∏√∑∫"))
)
#: Dingbats that don't follow from their code.
DINGBATS = dict(zip([0x25, 0x2A, 0x2B, 0x48, 0x6C, 0x6E, 0x73, 0x74, 0x75, 0x77, 0xA8, 0xA9, 0xAA, 0xAB, 0xD5, 0xD6, 0xD7], "☎☛☞★●■▲▼◆◗♣♦♥♠→↔↕"))


def encoded_text(encoding: str, code: int) -> str:
    """The text of a code: a Python codec, or one of the encodings that fonts alone use; empty if there is none."""
    if encoding == "none":
        return ""
    if encoding == "standard":
        return STANDARD.get(code) or (chr(code) if 32 <= code < 127 else "")
    if encoding == "symbol":
        return SYMBOL.get(code) or (chr(code) if 32 <= code < 65 or code in b"[]_{|}" else "")
    if encoding == "dingbats":
        first = 0x2700 if code < 0x7F else 0x2760 if code < 0xA8 else 0x2460 if code < 0xB6 else 0x2776 if code < 0xD4 else 0x2794
        base = 0x20 if code < 0x7F else 0xA0 if code < 0xA8 else 0xAC if code < 0xB6 else 0xB6 if code < 0xD4 else 0xD4
        return DINGBATS.get(code) or (" " if code == 32 else chr(first + code - base) if 33 <= code < 0x7F or 0xA1 <= code < 0xFF and code != 0xF0 else "")
    return bytes([code]).decode(encoding, "ignore")


def face_of(base: str) -> str:
    """The standard face whose widths stand in for a font, by its name; slanted Helvetica and Courier are as wide as upright."""
    name = base.split("+")[-1].lower()
    bold = "bold" in name or "black" in name or "heavy" in name
    if "courier" in name or "mono" in name:
        return "Courier"
    if "times" in name or "roman" in name or "serif" in name and "sans" not in name:
        slanted = "italic" in name or "oblique" in name
        return "Times-BoldItalic" if bold and slanted else "Times-Bold" if bold else "Times-Italic" if slanted else "Times-Roman"
    return "Helvetica-Bold" if bold else "Helvetica"


def char_width(char: str, face: str = "Helvetica") -> int:
    """Thousandths of an em; an accented letter is as wide as its base letter."""
    if face == "Courier":
        return 600
    if face == "Helvetica" and char in HELVETICA_OTHER:
        return HELVETICA_OTHER[char]
    base = unicodedata.normalize("NFD", char)[:1]
    table = OTHER_FACES.get(face, HELVETICA)
    return table[ord(base) - 32] if " " <= base <= "~" else DEFAULT_WIDTH


def width_rows(face: str = "Helvetica") -> list[tuple[str, int]]:
    """(character, width) of every character that the Windows Latin code page can show."""
    chars = [bytes([code]).decode("cp1252", "ignore") for code in range(32, 256)]
    return [(c, char_width(c, face)) for c in chars if c]


def subset_free(name: Column) -> Column:
    """A base font name without its subset tag."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


#: What in a font's name says bold, italic, serif and fixed pitch, and the descriptor flags that say the same.
BOLD = "bold black heavy semibold demibold".split()
BOLD_ENDS, ITALIC_ENDS = "bd", "it"
ITALIC = "italic oblique".split()
SERIF = "times georgia garamond book serif roman minion cambria palatino century caslon baskerville didot utopia charter".split()
MONO = "courier mono consolas menlo inconsolata typewriter".split()
FIXED_PITCH_FLAG, SERIF_FLAG, ITALIC_FLAG, BOLD_FLAG = 0, 1, 6, 18


def style_flags(name: Column, flags: Column) -> Column:
    """struct<family,serif,monospace,bold,italic>: by parts of the name, or by the descriptor's flags; family is the name up to its style."""
    has = lambda parts: name.rlike("(?i)" + "|".join(parts))
    ends = lambda part: name.rlike(rf"(?i)[-,_]{part}\b")
    bit = lambda k: F.shiftright(F.coalesce(flags, F.lit(0)), k).bitwiseAND(1) == 1
    family = F.get(F.split(subset_free(name), "[-,]"), F.lit(0))
    return F.struct(
        F.when(family == "", subset_free(name)).otherwise(family).alias("family"),
        (has(SERIF) | bit(SERIF_FLAG)).alias("serif"),
        (has(MONO) | bit(FIXED_PITCH_FLAG)).alias("monospace"),
        (has(BOLD) | ends(BOLD_ENDS) | bit(BOLD_FLAG)).alias("bold"),
        (has(ITALIC) | ends(ITALIC_ENDS) | bit(ITALIC_FLAG)).alias("italic"),
    )


def standard_face(name: Column) -> Column:
    """The one of the standard fonts that a base name means, or null: Arial, Courier New and Times New Roman in all the
    ways in which producers write them (PS and MT, a style behind a hyphen or comma, blanks) are their metric twins."""
    plain = F.regexp_replace(subset_free(name), r"[\s_]", "")
    parts = r"^(ArialUnicodeMS|Arial|Helvetica|CourierNew|Courier|TimesNewRoman|Times)(?:PS)?(?:MT)?[-,]?(Bold)?(Italic|Oblique|Roman)?(?:MT)?$"
    at = lambda k: F.regexp_extract(plain, parts, k)
    family = F.when(at(1).startswith("Courier"), "Courier").when(at(1).startswith("Times"), "Times").otherwise("Helvetica")
    slant = F.when(at(3).isin("Italic", "Oblique"), F.when(family == "Times", "Italic").otherwise("Oblique")).otherwise("")
    style = F.concat(at(2), slant)
    face = F.concat(family, F.when(style != "", F.concat(F.lit("-"), style)).when(family == "Times", "-Roman").otherwise(""))
    return F.when(plain.isin("Symbol", "ZapfDingbats"), plain).when(plain.rlike(parts), face)


#: Typographic characters and their plain forms.
FOLD_FROM = "‘’‚‛“”„‟–—−‐‑ "
FOLD_TO = "''''\"\"\"\"----- "[: len(FOLD_FROM)]


def folded(text: Column) -> Column:
    """Quotes, dashes and hard blanks in their plain forms."""
    return F.translate(text, FOLD_FROM, FOLD_TO)
