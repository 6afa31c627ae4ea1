"""ToUnicode and CID character maps and text encodings of fonts. Helpers inside Spark tasks, built on the lexer."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from quirefold.functions.fonts import ASCENT, DEFAULT_WIDTH, DESCENT, char_width, encoded_text, face_of
from quirefold.functions.lexer import Name, operations

#: Most codes that one range may name.
RANGE_CAP = 65_536


@dataclass
class CMap:
    """codespaces: (low, high, byte length); uni and cids: (byte length, code) -> text or CID."""

    codespaces: list[tuple[int, int, int]] = field(default_factory=list)
    uni: dict[tuple[int, int], str] = field(default_factory=dict)
    cids: dict[tuple[int, int], int] = field(default_factory=dict)
    vertical: bool = False
    uses: str = ""

    def decode(self, data: bytes) -> list[tuple[int, int]]:
        """(code, byte length): the shortest code space that holds the bytes; one byte less of the shortest, if none."""
        spaces = self.codespaces or [(0, 0xFFFF, 2)]
        lengths, out, at = sorted({s[2] for s in spaces}), [], 0
        if len(lengths) == 1:  # then a code that no space holds has the same length
            n = lengths[0]
            return [(int.from_bytes(part := data[k : k + n], "big"), len(part)) for k in range(0, len(data), n)]
        while at < len(data):
            for n in lengths:
                part = data[at : at + n]
                if len(part) == n and any(len_ == n and all(lo >> 8 * k & 255 <= part[n - 1 - k] <= hi >> 8 * k & 255 for k in range(n)) for lo, hi, len_ in spaces):
                    break
            else:
                n = lengths[0]
                part = data[at : at + n]
            out.append((int.from_bytes(part, "big"), len(part)))
            at += n
        return out


def utf16(data: bytes) -> str:
    """Big-endian UTF-16; lone surrogates become U+FFFD, an odd last byte is kept as it is."""
    even = data[: len(data) // 2 * 2]
    return even.decode("utf-16-be", "replace") + data[len(even) :].decode("latin-1")


def parse_cmap(program: bytes | None) -> CMap:
    out = CMap()
    value = lambda b: int.from_bytes(b, "big")
    for op in operations(program):
        args = op.operands
        if op.op == "endcodespacerange":
            for lo, hi in zip(args[::2], args[1::2]):
                if isinstance(lo, bytes) and isinstance(hi, bytes) and lo:
                    out.codespaces.append((value(lo), value(hi), len(lo)))
        elif op.op == "endbfchar":
            for code, to in zip(args[::2], args[1::2]):
                if isinstance(code, bytes) and isinstance(to, bytes) and not isinstance(to, Name):
                    out.uni[len(code), value(code)] = utf16(to)
        elif op.op == "endbfrange":
            for lo, hi, to in zip(args[::3], args[1::3], args[2::3]):
                if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                    continue
                for k in range(min(value(hi) - value(lo) + 1, RANGE_CAP)):
                    if isinstance(to, list):
                        text = utf16(to[k]) if k < len(to) and isinstance(to[k], bytes) else None
                    elif isinstance(to, bytes) and to:
                        text = utf16(to[:-2] + ((value(to[-2:]) + k) & 0xFFFF).to_bytes(min(2, len(to)), "big"))
                    else:
                        text = None
                    if text is not None:
                        out.uni[len(lo), value(lo) + k] = text
        elif op.op == "endcidchar":
            for code, cid in zip(args[::2], args[1::2]):
                if isinstance(code, bytes) and isinstance(cid, float):
                    out.cids[len(code), value(code)] = int(cid)
        elif op.op == "endcidrange":
            for lo, hi, cid in zip(args[::3], args[1::3], args[2::3]):
                if isinstance(lo, bytes) and isinstance(hi, bytes) and isinstance(cid, float):
                    out.cids.update({(len(lo), value(lo) + k): int(cid) + k for k in range(min(value(hi) - value(lo) + 1, RANGE_CAP))})
        elif op.op == "def" and len(args) >= 2 and args[-2] == b"WMode":
            out.vertical = args[-1] == 1
        elif op.op == "usecmap" and args and isinstance(args[-1], Name):
            out.uses = args[-1].decode("latin-1")
    if not out.codespaces:
        out.codespaces = [(0, (1 << 8 * n) - 1, n) for n in sorted({n for n, _ in [*out.uni, *out.cids]})]
    return out


@dataclass
class Glyph:
    code: int
    byte_len: int
    cid: int
    unicode: str
    width: float


class _Facts(dict):
    """code -> (text, width) of the codes of one length that a font has shown; emptied when there are many."""

    def __init__(self, font: "Font", n: int):
        super().__init__()
        self.font, self.n = font, n

    def __missing__(self, code: int) -> tuple[str, float]:
        if len(self) >= 1 << 17:
            self.clear()
        text = self.font._text(code, self.n)
        found = self[code] = text, self.font._width(code, self.font._cid(code, self.n), text)
        return found


class Font:
    """Decodes strings to glyphs. ``spec`` is a plain dictionary (JSON): base, type0, widths {code: w}, first, missing,
    default_width, to_unicode (hex of the program), differences {code: text}, encoding (a Python codec, or standard, symbol,
    dingbats or none), cid_widths [[first, last, w], ...] where later entries win, cmap (hex of an embedded encoding
    program) or cmap_name, ascent and descent (thousandths), subset, type3."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.base = spec.get("base", "Helvetica")
        self.type0 = bool(spec.get("type0"))
        self.face = face_of(self.base)
        self.ascent = spec["ascent"] / 1000 if spec.get("ascent") else ASCENT[self.face]
        self.descent = spec["descent"] / 1000 if spec.get("descent") else DESCENT[self.face]
        self.cmap = parse_cmap(bytes.fromhex(spec["to_unicode"])) if spec.get("to_unicode") else None
        name = spec.get("cmap_name") or "Identity-H"
        self.codes = parse_cmap(bytes.fromhex(spec["cmap"])) if spec.get("cmap") else CMap(codespaces=[(0, 0xFFFF, 2)], vertical=name == "Identity-V")
        self.issues = [] if spec.get("cmap") or name in ("Identity-H", "Identity-V") else [f"predefined-cmap:{name}"]
        self.widths = {int(k): float(v) for k, v in spec.get("widths", {}).items()}
        self.differences = {int(k): v for k, v in spec.get("differences", {}).items()}
        self.codec = spec.get("encoding", "cp1252")

    @property
    def vertical(self) -> bool:
        return self.type0 and self.codes.vertical

    def _named(self, code: int) -> str:
        """What the encoding says about a code of a simple font, differences first."""
        return self.differences.get(code) or encoded_text(self.codec, code)

    def _text(self, code: int, n: int) -> str:
        if self.cmap and (found := self.cmap.uni.get((n, code))):
            return found
        return "" if self.type0 else self._named(code)

    def _cid(self, code: int, n: int) -> int:
        return self.codes.cids.get((n, code), 0) if self.codes.cids else code

    def _width(self, code: int, cid: int, text: str) -> float:
        if self.type0:
            return next((float(w) for lo, hi, w in reversed(self.spec.get("cid_widths", [])) if lo <= cid <= hi), float(self.spec.get("default_width", 1000)))
        if code in self.widths:
            return self.widths[code]
        if not self.widths and text:
            return float(char_width(text, self.face))
        missing = float(self.spec.get("missing", 0))
        return missing if self.widths or missing > 0 else float(DEFAULT_WIDTH)

    def glyphs(self, data: bytes) -> list[Glyph]:
        out = []
        for code, n in self.codes.decode(data) if self.type0 else [(b, 1) for b in data]:
            text, cid = self._text(code, n), self._cid(code, n)
            out.append(Glyph(code, n, cid, text, self._width(code, cid, text)))
        return out

    def repertoire(self) -> list[tuple[int, int, str, float, int]]:
        """(code, byte length, text, width, rank) of all codes that can be written: rank 0 by ToUnicode, 1 by the
        encoding, 2 plain ASCII. Codes of a subset count only where widths attest them; none in vertical fonts and in
        fonts with an unknown predefined map."""
        if self.vertical or self.issues:
            return []
        found = []
        for (n, code), text in (self.cmap.uni if self.cmap else {}).items():
            if self.type0 or code < 256:
                found.append((code, n if self.type0 else 1, text, 0))
        if not self.type0:
            found += [(code, 1, text, 1) for code in range(256) if (text := self._named(code))]
            found += [(code, 1, chr(code), 2) for code in range(32, 127) if self.codec != "none" and not self._named(code)]
        out = []
        for code, n, text, rank in found:
            cid = self._cid(code, n)
            attested = any(lo <= cid <= hi for lo, hi, _ in self.spec.get("cid_widths", [])) if self.type0 else code in self.widths
            if text and not (self.type0 and cid == 0 and code) and (attested or not self.spec.get("subset")):
                out.append((code, n, text, self._width(code, cid, text), rank))
        return out

    @cached_property
    def table(self) -> tuple[list[str], list[float]] | None:
        """Text and width of each code of a single-byte font; None for fonts with longer codes."""
        if self.type0:
            return None
        text = [self._text(b, 1) for b in range(256)]
        return text, [self._width(b, b, t) for b, t in enumerate(text)]

    @cached_property
    def _facts(self) -> _Facts | None:
        """Of a composite font whose codes all have one length."""
        lengths = {n for _, _, n in self.codes.codespaces} or {2}
        return _Facts(self, lengths.pop()) if self.type0 and len(lengths) == 1 else None

    def measured(self, data: bytes) -> tuple[str, int, int, float, bool] | None:
        """(text, glyphs, one-byte codes 32, sum of widths, whether the last glyph is such a code) of a string whose codes
        all have one length and no negative widths; None for others, which ``glyphs`` takes apart."""
        if self.table:
            text, widths = self.table
            return "".join(map(text.__getitem__, data)), len(data), data.count(32), sum(map(widths.__getitem__, data)), data[-1:] == b" "
        if (facts := self._facts) is None or len(data) % (n := facts.n):
            return None
        codes = np.frombuffer(data, f">u{n}").tolist() if n in (1, 2, 4) else [int.from_bytes(data[k : k + n], "big") for k in range(0, len(data), n)]
        texts, widths = zip(*map(facts.__getitem__, codes)) if codes else ((), ())
        if min(widths, default=0.0) < 0:
            return None
        return "".join(texts), len(codes), data.count(32) if n == 1 else 0, sum(widths), n == 1 and data[-1:] == b" "

    @cached_property
    def space_width(self) -> float:
        w = self._width(32, 32, " ") if not self.type0 else 250.0
        return w if 0 < w <= 1000 else 250.0
