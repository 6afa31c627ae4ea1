"""Personal data (operator 5, DataFrame functions only).

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs), and words near a span
raise or lower its score. Base kinds (email, ip, card, phone) are reported whenever their own test holds; the added
kinds (iban, ssn, secret, token) only with a score of ``min_score`` or more. A secret is a private-key header or a key
with a provider's prefix and length; a token is any long run of letters and digits, with eight different characters or
more, that a word like token, key or password stands beside.

An account number (iban) ends where its country's length says, so what follows it takes no part; for countries that
aren't listed, each beginning of the match that ends at a blank is tested, the longest first. Words that raise a score
are looked for on both sides of a span, words that lower it only before it.

Positions are code points, ends exclusive. They come from the lengths of the pieces between matches; prefix sums are
taken in blocks. Context and masked text are cut from the text's pieces of ``PIECE`` characters, so that no span walks
the text from its start, and a text with very many spans costs in proportion to their number.

Defined results: null text counts as empty; a text without spans has an empty array; spans of different kinds may
overlap, and are ordered by start, then kind as listed; repeated rows are each answered; ``find`` returns the key and
the spans alone, ``mask`` all columns, whatever their names; an empty table gives no rows; there is no shuffle, so any
key or host may be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import ROW, whole_row

#: Lengths of account numbers by country (IBAN registry and the countries that use the form without it).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")"
_IBAN = "|".join(
    [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()] + [rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"]
)
#: The patterns, in the order in which kinds are listed. Lookbehinds and possessive quantifiers of the
#: base kinds only keep the search linear: no match starts inside a run of the same characters, unless one has just
#: ended there. An iban is captured ahead of an empty match, so that a false start doesn't hide a number behind it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=((?:{_IBAN})(?![A-Za-z0-9])))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,90}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{20,90}|[rs]k_live_[A-Za-z0-9]{20,90}|AIza[A-Za-z0-9_-]{35}|hf_[A-Za-z0-9]{34}|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_])",
    "token": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]{0,80}[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, words that raise it and words that lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.9, "token": 0.4}
RAISE = {
    "email": r"(?i)\b(e-?mail|mail|contact|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(ip|address|host|server|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|payment|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(ssn|social|security)\b",
    "secret": r"(?i)(secret|token|key|password)",
    "token": r"(?i)(?<![a-z])(secret|token|api_?key|access_?key|key|passwd|password|passwort|pwd|auth|authorization|bearer|credentials?|contraseña|clave)(?![a-z])",
}
LOWER = {
    "email": r"(?i)\b(example|noreply)\b",
    "ip": r"(?i)\b(version|release|section|v)\b",
    "card": r"(?i)\b(isbn|serial|order|token|hash)\b",
    "phone": r"(?i)\b(isbn|serial|order)\b",
    "iban": r"(?i)\b(serial|order)\b",
    "ssn": r"(?i)\b(serial|order|part)\b",
    "secret": r"(?i)\bexample\b",
    "token": r"(?i)\b(sha1|sha256|md5|checksum|commit|digest|isbn)\b",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BLOCK = 256
#: Characters in a piece of a text from which context and masked text are cut.
PIECE = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """True if the account number with its first four characters moved to the end is 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), (s * 10 + (F.ascii(c) - 48)) % 97).otherwise((s * 100 + (F.ascii(c) - 55)) % 97).cast("int"),
    )
    return value == 1


def confirmed(kind: str, match: Column) -> Column:
    """The test of one kind: Luhn, mod-97, number of digits or range of parts."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _let(_digits(match), lambda d: F.char_length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "token":
        return match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(F.substring(match, 1, 200), ""))) > 8)
    return F.lit(True)


def _confirmed_part(kind: str, match: Column) -> Column:
    """The match if it passes its test; of an account number of an unlisted country the part that does; else null."""
    if kind != "iban":
        return F.when(confirmed(kind, match), match)

    def beginnings(parts: Column) -> Column:
        return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), " "))

    tried = F.when(match.rlike(f"^{_LISTED}"), F.array(match)).otherwise(_let(F.split(match, " "), beginnings))
    return F.get(F.filter(tried, lambda x: (F.char_length(F.regexp_replace(x, " ", "")) >= 15) & confirmed(kind, x)), 0)


def _starts(steps: Column) -> Column:
    """Exclusive prefix sums of an array of longs."""
    add = lambda s, x: s + x
    zero = F.lit(0).cast("long")

    def from_blocks(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(a, b * _BLOCK + 1, _BLOCK), zero, add))
        bases = F.aggregate(blocks, F.array(zero), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        return _let(bases, lambda base: F.transform(a, lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int")) + F.aggregate(F.slice(a, i - i % _BLOCK + 1, i % _BLOCK), zero, add)))

    return from_blocks(steps)


def _proposed(text: Column, kind: str) -> Column:
    """array<struct<start,rank,end,kind,match>> of the confirmed matches of one kind."""
    pattern, rank, ahead = PATTERNS[kind], list(PATTERNS).index(kind), kind == "iban"
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")

    def placed(m: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(m, lambda x, i: (F.char_length(F.get(gaps, i)) + (0 if ahead else F.char_length(x))).cast("long"))
            placed_at = lambda s, x: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.char_length(x)).alias("end"), F.lit(kind).alias("kind"))
            return _let(
                _let(steps, _starts),
                lambda at: F.filter(
                    F.transform(m, lambda x, i: _let(_confirmed_part(kind, x), lambda part: F.when(part.isNotNull(), _let(F.get(at, i) + F.char_length(F.get(gaps, i)) - int(ahead), lambda s: placed_at(s, part))))),
                    lambda x: x.isNotNull(),
                ),
            )

        # most matches fail their test; then nothing has to be placed
        pieces = F.split(F.concat(F.lit(" "), text) if ahead else text, pattern, -1)  # an empty match at the very start would not split
        return F.when(F.exists(m, lambda x: _confirmed_part(kind, x).isNotNull()), _let(pieces, with_gaps)).otherwise(none)

    sign = {"email": F.contains(text, F.lit("@")), "secret": text.rlike("-----BEGIN |AKIA|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|k_live_|AIza|hf_|eyJ")}.get(kind, text.rlike("[0-9]"))
    return F.when(sign, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(int(ahead))), placed)).otherwise(none)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of the text in pieces; empty if there are none."""
    whole = lambda k: F.coalesce(F.get(pieces, k.cast("int")), F.lit(""))
    first, last = F.floor(a / PIECE), F.floor(b / PIECE)
    here, until = (a % PIECE + 1).cast("int"), (b % PIECE).cast("int")
    between = F.when(last > first + 1, F.array_join(F.slice(pieces, (first + 2).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int")), "")).otherwise("")
    return F.when(b <= a, "").when(first == last, F.substring(whole(first), here, (b - a).cast("int"))).otherwise(F.concat(F.substring(whole(first), here, F.lit(PIECE)), between, F.substring(whole(last), F.lit(1), until)))


def spans(text: Column, min_score: float = 0.5, window: int = 40) -> Column:
    """array<struct<start,rank,end,kind,score>> by start, then kind as listed; text must not be null."""

    def scored(pieces: Column):
        def of(s: Column) -> Column:
            def judged(near: Column) -> Column:
                before, after = near["before"], near["after"]
                score = F.lit(0.0)
                for kind in reversed(PATTERNS):
                    own = F.lit(SCORES[kind]) + F.when(before.rlike(RAISE[kind]) | after.rlike(RAISE[kind]), 0.2).otherwise(0.0) - F.when(before.rlike(LOWER[kind]), 0.3).otherwise(0.0)
                    score = F.when(s["kind"] == kind, own).otherwise(score)
                return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

            around = F.struct(_cut(pieces, F.greatest(s["start"] - window, F.lit(0)), s["start"]).alias("before"), _cut(pieces, s["end"], s["end"] + window).alias("after"))
            return _let(around, judged)

        return of

    def kept(found: Column) -> Column:
        judged = _let(_pieces(text), lambda pieces: F.transform(found, scored(pieces)))
        return F.sort_array(F.filter(judged, lambda s: s["kind"].isin(*BASE) | (s["score"] >= min_score)))

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    return _let(F.concat(*[_proposed(text, kind) for kind in PATTERNS]), lambda found: F.when(F.size(found) > 0, kept(found)).otherwise(none))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = 0.5) -> DataFrame:
    """key, pii: array<struct<start,rank,end,kind,score>>; one row per input row."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_qf_t"))
    return rows.select(F.col(key), spans(F.col("_qf_t"), min_score).alias("pii"))


def _highest(ends: Column) -> Column:
    """For each element the highest one before it, 0 for the first; in blocks, like ``_starts``."""
    zero = F.lit(0).cast("long")
    most = lambda s, x: F.greatest(s, x)

    def from_blocks(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(a, b * _BLOCK + 1, _BLOCK), zero, most))
        bases = F.aggregate(blocks, F.array(zero), lambda s, x: F.concat(s, F.array(F.greatest(F.element_at(s, -1), x))))
        return _let(bases, lambda base: F.transform(a, lambda _, i: F.aggregate(F.slice(a, i - i % _BLOCK + 1, i % _BLOCK), F.get(base, F.floor(i / _BLOCK).cast("int")), most)))

    return _let(ends, from_blocks)


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in capitals and angle brackets; overlapping spans become one.

    ``found`` must have a span.
    """

    def joined(v: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            done = F.get(v["done"], i)
            return F.when(x["start"] >= done, F.concat(_cut(v["pieces"], done, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")

        end = F.greatest(F.element_at(v["done"], -1), F.element_at(found, -1)["end"])
        return F.concat(F.array_join(F.transform(found, part), ""), _cut(v["pieces"], end, F.char_length(text).cast("long")))

    return _let(F.struct(_pieces(text).alias("pieces"), _highest(F.transform(found, lambda x: x["end"])).alias("done")), joined)


def mask(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """All columns, the text without personal data; null text stays null, a text without spans stays as it is."""
    rows = whole_row(docs, _qf_t=F.col(text)).withColumn("_qf_s", spans(F.coalesce("_qf_t", F.lit("")), min_score))
    clean = F.when(F.size("_qf_s") == 0, F.col("_qf_t")).otherwise(masked(F.col("_qf_t"), F.col("_qf_s")))
    return rows.select(*[clean.alias(c) if c == text else F.col(f"{ROW}.`{c}`") for c in docs.columns])
