"""From page content to operators and positioned text runs.

Streams are rows (doc_id, page_index, content, fonts, forms, spaces): content is the page's bytes, fonts maps resource
names to a font description (JSON), forms maps names to struct<content,matrix> and, where a form has resources of its
own, fonts, names (its names of forms to keys of this map) and key (its object); spaces maps names of colour spaces to
gray, rgb, cmyk or tint. One row is one page, so the fold over its
operators needs no shuffle; the two Python stages here (operators, runs) are narrow, and everything after them is
built-in expressions. A page that can't be read gives the runs up to the fault and no failure of the job.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quirefold.functions.cmap import Font
from quirefold.functions.lexer import Name, Op, operations
from quirefold.functions.pdfobjects import text_string

OPS = "doc_id bigint, page_index int, op_seq int, op string, start bigint, end bigint, op_start bigint, nums array<double>, name string, strings array<binary>"
RUNS = (
    "doc_id bigint, page_index int, run_seq int, stream_key string, start bigint, end bigint, op string, font_name string, font_size double, char_spacing double, word_spacing double, "
    "horiz_scale double, leading double, rise double, render_mode int, ctm array<double>, text_matrix array<double>, text string, n_glyphs int, n_spaces int, width_sum double, "
    "tj_adjustment double, advance double, x double, y double, x0 double, y0 double, x1 double, y1 double, effective_size double, text_to_page double, angle double, fill array<double>, "
    "safe_delete boolean, actual_text string, vertical boolean, stroke array<double>, line_width double, n_bytes int"
)
#: Deepest nesting of forms.
FORM_DEPTH = 8
_EYE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
Matrix = tuple[float, float, float, float, float, float]


def operators(streams: DataFrame) -> DataFrame:
    """One row per operator of each stream, with its byte span and flat operands."""

    columns = [c.split()[0] for c in OPS.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, page, content in zip(batch["doc_id"], batch["page_index"], batch["content"]):
                for k, o in enumerate(operations(content)):
                    flat = [y for x in o.operands for y in (x if isinstance(x, list) else [x])]
                    name = next((x.decode("latin-1") for x in flat if isinstance(x, Name)), None)
                    out.append((doc, page, k, o.op, o.start, o.end, o.op_start, [x for x in flat if isinstance(x, float)], name, [bytes(x) for x in flat if isinstance(x, bytes) and not isinstance(x, Name)]))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return streams.select("doc_id", "page_index", "content").mapInPandas(rows, OPS)


def _mul(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


@dataclass
class State:
    """What q saves and Q brings back."""

    ctm: Matrix = _EYE
    font: Font | None = None
    font_name: str = ""
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    fill: tuple[float, ...] | None = (0.0, 0.0, 0.0)
    space: str = "gray"
    stroke: tuple[float, ...] | None = (0.0, 0.0, 0.0)
    stroke_space: str = "gray"
    pen: float = 1.0


#: Colour spaces that need no resource.
DEVICE = {"DeviceGray": "gray", "G": "gray", "CalGray": "gray", "DeviceRGB": "rgb", "RGB": "rgb", "CalRGB": "rgb", "Lab": "rgb", "DeviceCMYK": "cmyk", "CMYK": "cmyk"}


def rgb(space: str, parts: list[float]) -> tuple[float, ...] | None:
    """Components as red, green and blue; a tint is ink on white; an unknown space goes by their number."""
    parts = [min(1.0, max(0.0, p)) for p in parts]
    if space == "tint" and parts:
        return (1 - parts[-1],) * 3
    wanted = {"gray": 1, "rgb": 3, "cmyk": 4}.get(space, len(parts))
    if len(parts) < wanted or wanted not in (1, 3, 4):
        return None
    if wanted == 1:
        return (parts[0],) * 3
    return tuple((1 - p) * (1 - parts[3]) for p in parts[:3]) if wanted == 4 else tuple(parts[:3])


@dataclass
class Form:
    """What a form draws; without fonts or names of its own those of the stream that shows it count."""

    content: bytes
    matrix: Matrix
    fonts: dict[str, Font] | None = None
    names: dict[str, str] | None = None
    key: str = ""


@dataclass
class Page:
    """The fold over one page's operators."""

    fonts: dict[str, Font]
    forms: dict[str, Form]
    spaces: dict[str, str] = field(default_factory=dict)
    states: dict[str, tuple[float, bool]] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    runs: list[dict] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)

    def show(self, s: State, tm: Matrix, o: Op, key: str, items: list, marked: list[str]) -> Matrix:
        """Emits a run; returns the text matrix after it."""
        advance = kerns = widths = 0.0
        text, made, glyphs, spaces = "", 0, 0, 0
        base = (s.size * s.scale, 0.0, 0.0, s.size, 0.0, s.rise)
        up, down = (s.font.ascent, s.font.descent) if s.font else (0.9, -0.22)
        em = (s.font.space_width if s.font else 250.0) / 1000
        at = _mul(base, _mul(tm, s.ctm))
        xs: list[float] = []
        ys: list[float] = []
        step = s.size * s.scale
        for item in items:
            if isinstance(item, float):
                kerns += item
                if -item / 1000 >= 0.6 * em and text and not text.endswith(" "):
                    text, made = text + " ", made + 1
                advance -= item / 1000 * step
                continue
            if not isinstance(item, bytes) or s.font is None:
                continue
            if item and not made and s.char >= 0 and s.word >= 0 and step > 0 and (whole := s.font.measured(item)):
                # a plain string moves only forward: its box spans from its first glyph to its last
                shown, n, blanks, total, blank = whole
                start = advance / step
                advance += (total / 1000 * s.size + n * s.char + blanks * s.word) * s.scale
                last = advance / step - (s.char + (s.word if blank else 0.0)) / s.size
                for px in (start, last):
                    for gy in (down, up):
                        xs.append(at[0] * px + at[2] * gy + at[4])
                        ys.append(at[1] * px + at[3] * gy + at[5])
                glyphs, spaces, widths, text = glyphs + n, spaces + blanks, widths + total, text + shown
                continue
            for g in s.font.glyphs(item):
                if g.unicode == " " and made and text.endswith(" "):
                    text, made = text[:-1], made - 1
                blank = g.byte_len == 1 and g.code == 32
                w = g.width / 1000
                for gx in (0.0, w):
                    for gy in (down, up):
                        px = gx + (advance / step if step else 0.0)
                        xs.append(at[0] * px + at[2] * gy + at[4])
                        ys.append(at[1] * px + at[3] * gy + at[5])
                glyphs, spaces, widths, text = glyphs + 1, spaces + blank, widths + g.width, text + g.unicode
                advance += (w * s.size + s.char + (s.word if blank else 0.0)) * s.scale
        after = _mul((1.0, 0.0, 0.0, 1.0, advance, 0.0), tm)
        if not glyphs and not any(isinstance(i, bytes) for i in items):
            return after
        both = _mul(tm, s.ctm)
        wide = math.hypot(at[0], at[1])
        self.runs.append(
            {
                "run_seq": len(self.runs), "stream_key": key, "start": o.start, "end": o.end, "op": o.op, "font_name": s.font_name, "font_size": s.size, "char_spacing": s.char, "word_spacing": s.word,
                "horiz_scale": s.scale, "leading": s.leading, "rise": s.rise, "render_mode": s.mode, "ctm": list(s.ctm), "text_matrix": list(tm), "text": text, "n_glyphs": glyphs, "n_spaces": spaces,
                "width_sum": widths, "tj_adjustment": kerns, "advance": advance, "x": at[4], "y": at[5], "x0": min(xs, default=at[4]), "y0": min(ys, default=at[5]), "x1": max(xs, default=at[4]), "y1": max(ys, default=at[5]),
                "effective_size": abs(at[0] * at[3] - at[1] * at[2]) / wide if wide else math.hypot(at[2], at[3]), "text_to_page": math.hypot(both[0], both[1]) or 1.0, "angle": math.atan2(at[1], at[0]),
                "fill": list(s.fill) if s.fill else None, "safe_delete": False, "actual_text": marked[-1] if marked else None,
                "vertical": s.font is not None and s.font.vertical, "stroke": list(s.stroke) if s.stroke else None, "line_width": s.pen, "n_bytes": sum(len(i) for i in items if isinstance(i, bytes)),
            }
        )
        return after

    def run(self, content: bytes, key: str, s: State, depth: int = 0, active: frozenset[str] = frozenset(), fonts: dict[str, Font] | None = None, names: dict[str, str] | None = None) -> None:
        fonts = self.fonts if fonts is None else fonts
        stack: list[State] = []
        marked: list[str] = []
        tm = tlm = _EYE
        inside = False
        waiting: list[dict] = []  # runs of this stream since the last operator that sets the text matrix
        for o in operations(content):
            nums = [x for x in o.operands if isinstance(x, float)]
            num = lambda k: nums[k] if k < len(nums) else 0.0  # noqa: B023, E731
            name = next((x.decode("latin-1") for x in o.operands if isinstance(x, Name)), "")
            op = o.op
            before = len(self.runs)
            if op == "q":
                stack.append(replace(s))
            elif op == "Q":
                s = stack.pop() if stack else s
            elif op == "cm":
                s.ctm = _mul(tuple(num(k) for k in range(6)), s.ctm)
            elif op in ("g", "rg", "k"):
                s.space = {"g": "gray", "rg": "rgb", "k": "cmyk"}[op]
                s.fill = rgb(s.space, nums)
            elif op == "cs":  # the colour stays until one is set
                s.space = DEVICE.get(name) or self.spaces.get(name, "unknown")
            elif op in ("sc", "scn"):
                s.fill = None if name else rgb(s.space, nums)
            elif op in ("G", "RG", "K"):
                s.stroke_space = {"G": "gray", "RG": "rgb", "K": "cmyk"}[op]
                s.stroke = rgb(s.stroke_space, nums)
            elif op == "CS":
                s.stroke_space = DEVICE.get(name) or self.spaces.get(name, "unknown")
            elif op in ("SC", "SCN") and (nums or s.stroke_space == "unknown"):  # a pattern alone changes nothing in a known space
                s.stroke = rgb(s.stroke_space, nums) if nums else None
            elif op == "w":
                s.pen = num(0)
            elif op in ("BMC", "BDC"):
                actual = next((x.get(b"ActualText") for x in o.operands if isinstance(x, dict)), None)
                listed = [x.decode("latin-1") for x in o.operands if isinstance(x, Name)]
                text = text_string(actual) if isinstance(actual, bytes) else self.properties.get(listed[1]) if op == "BDC" and len(listed) > 1 else None
                marked.append(text if text is not None else marked[-1] if marked else "")
            elif op == "EMC":
                marked = marked[:-1]
            elif op == "BT":
                tm = tlm = _EYE
                inside = True
            elif op == "ET":
                inside = False
            elif op == "Tc":
                s.char = num(0)
            elif op == "Tw":
                s.word = num(0)
            elif op == "Tz":
                s.scale = num(0) / 100
            elif op == "TL":
                s.leading = num(0)
            elif op == "Ts":
                s.rise = num(0)
            elif op == "Tr":
                s.mode = int(num(0))
            elif op == "Tf":
                s.font_name, s.size, s.font = name, num(0), fonts.get(name)
            elif op == "gs" and name in self.states:
                s.size, named = self.states[name]
                if named:
                    s.font_name, s.font = f"gs:{name}", fonts.get(f"gs:{name}") or self.fonts.get(f"gs:{name}")
            elif op in ("Td", "TD", "T*"):
                if op == "TD":
                    s.leading = -num(1)
                tm = tlm = _mul((1.0, 0.0, 0.0, 1.0, *((0.0, -s.leading) if op == "T*" else (num(0), num(1)))), tlm)
            elif op == "Tm":
                tm = tlm = tuple(num(k) for k in range(6))
            elif op in ("Tj", "TJ", "'", '"') and inside:
                if op in ("'", '"'):
                    if op == '"':
                        s.word, s.char = num(0), num(1)
                    tm = tlm = _mul((1.0, 0.0, 0.0, 1.0, 0.0, -s.leading), tlm)
                    for r in waiting:
                        r["safe_delete"] = True
                    waiting = []
                last = o.operands[-1] if o.operands else None
                items = last if isinstance(last, list) else [last]
                tm = self.show(s, tm, o, key, [i for i in items if isinstance(i, (float, bytes)) and not isinstance(i, Name)], marked)
                waiting = self.runs[before:] if len(self.runs) > before else waiting
            elif op == "Do" and (at := name if names is None else names.get(name, "")) in self.forms and depth < FORM_DEPTH and at not in active:
                form = self.forms[at] if isinstance(self.forms[at], Form) else Form(*self.forms[at])
                own = f"xobj:{form.key or name}"
                self.uses.append(own)
                self.run(form.content, own, replace(s, ctm=_mul(form.matrix, s.ctm)), depth + 1, active | {at}, fonts if form.fonts is None else form.fonts, names if form.names is None else form.names)
            if op in ("BT", "Td", "TD", "T*", "Tm"):
                for r in waiting:
                    r["safe_delete"] = True
                waiting = []


_FONTS: dict[str, Font] = {}


def _font(spec: str) -> Font:
    """Read once per Python worker; few are kept, since a composite font has up to 65,536 codes a range."""
    if spec not in _FONTS:
        if len(_FONTS) >= 64:
            _FONTS.pop(next(iter(_FONTS)))
        _FONTS[spec] = Font(json.loads(spec))
    return _FONTS[spec]


def _folded(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Page]]:
    """(document, page index, the page after its fold) of each row of a batch."""

    names = batch.schema.names
    column = lambda c: batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows
    for doc, index, content, fonts, forms, spaces, states, properties in zip(*map(column, ("doc_id", "page_index", "content", "fonts", "forms", "spaces", "states", "properties"))):
        made = {}
        for name, f in forms or []:
            own = {n: _font(spec) for n, spec in f["fonts"]} if f.get("fonts") else None
            made[name] = Form(f["content"], tuple(f["matrix"]) if f["matrix"] is not None else _EYE, own, dict(f["names"]) if f.get("names") is not None else None, f.get("key") or "")
        page = Page({n: _font(spec) for n, spec in fonts or []}, made, dict(spaces or []), {n: (x["size"], x["named"]) for n, x in states or []}, dict(properties or []))
        page.run(content, f"page:{index}", State())
        yield doc, index, page


def _streams(streams: DataFrame) -> DataFrame:
    return streams.select("doc_id", "page_index", "content", "fonts", *[c for c in ("forms", "spaces", "states", "properties") if c in streams.columns])


def text_runs(streams: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per text-showing operator that shows text; ``columns`` beside doc_id and page_index, all if not given."""
    schema = StructType.fromDDL(RUNS)
    schema = StructType([f for f in schema if columns is None or f.name in ("doc_id", "page_index", *columns)])
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], kind) for n, kind in kinds.items()], names=list(kinds))

        for batch in batches:
            for doc, index, page in _folded(batch):
                for run in page.runs:
                    run["doc_id"], run["page_index"] = doc, index
                held += page.runs
                if len(held) >= 5000:
                    yield sent()
                    held = []
        if held:
            yield sent()

    return _streams(streams).mapInArrow(rows, schema)


def form_uses(streams: DataFrame) -> DataFrame:
    """doc_id, page_index, stream_key: one row each time a page shows a form."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(doc, index, key) for doc, index, page in _folded(batch) for key in page.uses]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "page_index", "stream_key"])

    return _streams(streams).mapInArrow(rows, "doc_id bigint, page_index int, stream_key string")
