"""A byte-exact reader of page content: operators with their operands and byte spans. A helper inside Spark tasks.

Operands are plain Python values: float, bytes (a string), ``Name``, list, dict, bool and None.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Deepest nesting of arrays and dictionaries, and most operands that one operator keeps.
MAX_DEPTH, MAX_OPERANDS = 64, 1_000_000
_SPACE = b"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_TRIVIA = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]*((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_STRING_PART = re.compile(rb"[^()\\\r]+")
#: Escapes in strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
#: Components of colour spaces, by which unfiltered inline images have an exact length.
_COMPONENTS = {b"DeviceGray": 1, b"G": 1, b"CalGray": 1, b"DeviceRGB": 3, b"RGB": 3, b"CalRGB": 3, b"DeviceCMYK": 4, b"CMYK": 4}


class Name(bytes):
    """A name without its slash, escapes resolved."""


@dataclass
class Op:
    op: str
    start: int
    end: int
    op_start: int
    operands: list


def number(token: bytes) -> float | None:
    """The number that a token begins with: signs in front, then digits; null if there are none."""
    m = _NUMBER.match(token)
    if not m:
        return None
    value = float(m[1])
    if value in (float("inf"), float("-inf")):
        return 0.0
    return -value if b"-" in token[: m.start(1)] else value


@dataclass(frozen=True)
class Ref:
    """A reference to an object of the file."""

    number: int
    generation: int


class Lexer:
    """With ``refs``, two numbers and R inside arrays and dictionaries are a reference."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = False):
        self.data, self.at, self.refs = data, at, refs

    def trivia(self) -> None:
        self.at = _TRIVIA.match(self.data, self.at).end()

    def literal(self) -> bytes:
        """A string in parentheses; ``at`` is after the opening one."""
        out, depth, data = [], 1, self.data
        while self.at < len(data):
            if m := _STRING_PART.match(data, self.at):
                out.append(m[0])
                self.at = m.end()
                continue
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"(":
                depth += 1
                out.append(c)
            elif c == b")":
                depth -= 1
                if not depth:
                    break
                out.append(c)
            elif c == b"\r":
                self.at += data[self.at : self.at + 1] == b"\n"
                out.append(b"\n")
            else:  # a backslash
                c = data[self.at : self.at + 1]
                self.at += 1
                if c in _ESCAPES:
                    out.append(_ESCAPES[c])
                elif c == b"\r":
                    self.at += data[self.at : self.at + 1] == b"\n"
                elif c.isdigit() and c < b"8":
                    m = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)
                    self.at = m.end()
                    out.append(bytes([int(m[0], 8) & 255]))
                elif c != b"\n":
                    out.append(c)
        return b"".join(out)

    def hexadecimal(self) -> bytes:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
        self.at = min(end + 1, len(self.data))
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def name(self) -> Name:
        m = _TOKEN.match(self.data, self.at)
        raw = m[0] if m else b""
        self.at += len(raw)
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw))

    def value(self, depth: int = 0) -> tuple[str, object]:
        """("value", v), ("word", keyword), ("close", delimiter) or ("end", None)."""
        self.trivia()
        data = self.data
        if self.at >= len(data):
            return "end", None
        c = data[self.at : self.at + 1]
        if c == b"(":
            self.at += 1
            return "value", self.literal()
        if c == b"/":
            self.at += 1
            return "value", self.name()
        if data.startswith(b"<<", self.at) or c == b"[":
            wide = c == b"<"
            self.at += 1 + wide
            if depth >= MAX_DEPTH:
                return "close", c
            items = []
            while True:
                kind, v = self.value(depth + 1)
                if kind == "value":
                    items.append(v)
                elif kind == "word":
                    if self.refs and v == b"R" and len(items) > 1 and all(isinstance(x, float) for x in items[-2:]):
                        items[-2:] = [Ref(int(items[-2]), int(items[-1]))]
                        continue
                    if v not in (b"true", b"false", b"null"):
                        self.at -= len(v)  # a lost closer: the operator comes next
                        break
                    items.append({b"true": True, b"false": False}.get(v))
                elif kind == "end" or v == (b">>" if wide else b"]"):
                    break
            if not wide:
                return "value", items
            return "value", {bytes(k): v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        if c == b"<":
            self.at += 1
            return "value", self.hexadecimal()
        if c in b")]}{>":
            wide = data.startswith(b">>", self.at)
            self.at += 1 + wide
            return "close", b">>" if wide else c
        token = _TOKEN.match(data, self.at)[0]
        self.at += len(token)
        if token[:1] in b"+-.0123456789" and (token[:1].isdigit() or len(token) > 1 or token in (b"+", b"-", b".")):
            return "value", number(token) or 0.0
        return "word", token

    def image(self, start: int) -> Op:
        """From BI to EI: exact length if it is known and EI follows, else the next EI that white space precedes. Eight bits a
        component and one component are meant if nothing is said, one bit in a mask."""
        keys: dict[bytes, object] = {}
        key = None
        while True:
            kind, v = self.value()
            if kind == "end" or kind == "word" and v == b"ID":
                break
            if kind == "word" and key is not None and v in (b"true", b"false", b"null"):
                kind, v = "value", {b"true": True, b"false": False}.get(v)
            if kind == "value":
                if key is None and isinstance(v, Name):
                    key = bytes(v)
                elif key is not None:
                    keys[key], key = v, None
        self.at += 1  # one white-space byte after ID
        first, end = self.at, -1
        get = lambda *names: next((keys[n] for n in names if n in keys), None)
        width, height, bits = (get(*n) for n in ((b"W", b"Width"), (b"H", b"Height"), (b"BPC", b"BitsPerComponent")))
        mask, space, coded = get(b"IM", b"ImageMask") is True, get(b"CS", b"ColorSpace"), get(b"F", b"Filter")
        parts = 1 if mask or space is None else _COMPONENTS.get(bytes(space)) if isinstance(space, Name) else None
        if (coded is None or coded == []) and parts and isinstance(width, float) and isinstance(height, float):
            depth = 1 if mask else int(bits) if isinstance(bits, float) else 8
            exact = first + int(height) * ((int(width) * parts * depth + 7) // 8)
            if m := re.compile(rb"[\x00\t\n\x0c\r ]*EI(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(self.data, exact):
                end = m.end()
        if end < 0:
            after = rb"EI(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)"
            m = re.compile(after).match(self.data, first) or re.compile(rb"(?<=[\x00\t\n\x0c\r ])" + after).search(self.data, first)
            end = m.end() if m else len(self.data)
        self.at = end
        return Op("EI", start, end, max(start, end - 2), [])

    def operations(self) -> Iterator[Op]:
        operands: list = []
        start = -1
        while True:
            self.trivia()
            here = self.at
            kind, v = self.value()
            if kind == "end":
                return
            if kind == "close":
                continue
            start = here if start < 0 else start
            if kind == "value":
                operands.append(v)
                if len(operands) > MAX_OPERANDS:
                    del operands[0]
                continue
            if v in (b"true", b"false", b"null"):
                operands.append({b"true": True, b"false": False}.get(v))
                continue
            if v == b"BI":
                yield self.image(start)
            else:
                yield Op(v.decode("latin-1"), start, self.at, here, operands)
            operands, start = [], -1


def operations(data: bytes | None) -> Iterator[Op]:
    return Lexer(data or b"").operations()
