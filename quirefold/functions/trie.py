"""What a font can write, compiled to arrays: the longest match at every position of a text at once.

A trie's edges are sorted numbers (node, character), so all positions of a text take one step by one binary search; as
many steps as the longest key has characters. Small helpers inside tasks.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from quirefold.functions.cmap import Font
from quirefold.functions.fonts import FOLD_FROM, FOLD_TO

#: The longest key of the reverse map, and characters that are spelled out or dropped where a font lacks them.
LONGEST = 4
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆĲĳŒœÆæ"
FOLDS = {**dict(zip(FOLD_FROM, FOLD_TO)), "…": "...", "⁄": "/", **dict.fromkeys("­​﻿‌‍", ""), **dict.fromkeys("             　", " ")}
#: A number that is no character: texts are put one behind another with it between them.
BREAK = 0x1FFFFF


def stand_ins(c: str) -> list[str]:
    """What may stand in for a character, the best first."""
    found = [unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c)]
    found += [FOLDS[c]] if c in FOLDS else []
    found += [unicodedata.normalize("NFKD", c)] if c in LIGATURES else []
    return [x for x in dict.fromkeys(found) if x != c]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")


class Encoder:
    """Entries are (code, byte length, width); of several codes of one text the best rank counts, then the lowest code."""

    def __init__(self, font: Font):
        self.font = font
        listed = font.repertoire()
        self.attested = {(code, n) for code, n, *_ in listed}
        best: dict[str, tuple] = {}
        for code, n, text, width, rank in listed:
            if (len(text) == 1 or (len(text) <= LONGEST and text.isalpha())) and (text not in best or (rank, code) < best[text][:2]):
                best[text] = (rank, code, n, width)
        self.entries = [(code, n, width) for _, code, n, width in best.values()]
        self.numbers = {e: k for k, e in enumerate(self.entries)}
        self.keys = {text: k for k, text in enumerate(best)}
        edges, ends = {}, [-1]
        for text, entry in self.keys.items():
            node = 0
            for c in points(text).tolist():
                node = edges.setdefault(node << 21 | c, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = entry
        self.edges = np.array(sorted(edges), "i8")
        self.nodes = np.array([edges[e] for e in self.edges.tolist()], "i8")
        self.ends = np.array(ends, "i8")
        self.deepest = max(map(len, best), default=0)
        self.spelled: dict[int, list[int] | None] = {}

    def matched(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of the longest key at each position, -1 if there is none; its characters, 1 if there is none)."""
        best, size = np.full(len(cps), -1, "i8"), np.ones(len(cps), "i8")
        at, node = np.arange(len(cps)), np.zeros(len(cps), "i8")
        for depth in range(self.deepest):
            inside = at + depth < len(cps)
            at, node = at[inside], node[inside]
            key = node << 21 | cps[at + depth]
            k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[k] == key
            at, node = at[found], self.nodes[k[found]]
            real = self.ends[node] >= 0
            best[at[real]], size[at[real]] = self.ends[node[real]], depth + 1
            if not len(at):
                break
        return best, size

    def _instead(self, c: int) -> list[int] | None:
        """Entries of the first stand-in whose characters the font all has."""
        if c not in self.spelled:
            forms = [[self.keys.get(x) for x in form] for form in stand_ins(chr(c))]
            self.spelled[c] = next((f for f in forms if None not in f), None)
        return self.spelled[c]

    def _number(self, code: int, n: int, text: str) -> int:
        entry = (code, n, self.font._width(code, self.font._cid(code, n), text))
        if entry not in self.numbers:
            self.numbers[entry] = len(self.entries)
            self.entries.append(entry)
        return self.numbers[entry]

    def hinted(self, original: bytes) -> dict[str, int]:
        """text -> entry of the first code that a string of this font shows it with, where that isn't the map's own."""
        found: dict[str, tuple[int, int]] = {}
        # the different codes in the order of their first places: a text has few of them, however long it is
        codes = dict.fromkeys(self.font.codes.decode(original)) if self.font.type0 else [(b, 1) for b in dict.fromkeys(original)]
        for code, n in codes:
            if text := self.font._text(code, n):
                found.setdefault(text, (code, n))
        return {t: k for t, (code, n) in found.items() if (code, n) in self.attested and (len(t) == 1 or t in self.keys) and (k := self._number(code, n, t)) != self.keys.get(t)}

    def encode(self, texts: list[str], hints: dict[str, int] | None = None) -> list[tuple[bytes, float, int, int, list[str]]]:
        """(bytes, width, glyphs, one-byte codes 32, characters that have neither key nor stand-in) of each text."""
        if not texts:
            return []
        parts = [points(t) for t in texts]
        cps = np.concatenate([x for p in parts for x in (p, np.array([BREAK]))])
        best, size = self.matched(cps)
        plain = best.copy() if hints else best  # each position goes by one hint, whatever their order
        for text, entry in (hints or {}).items():
            own = self.keys.get(text)
            if own is not None:
                best[plain == own] = entry
            else:
                best[(plain < 0) & (cps == ord(text))] = entry
        taken = np.ones(len(cps), bool)
        for k in np.flatnonzero(size > 1).tolist():  # keys of several letters cover the positions behind them
            if taken[k]:
                taken[k + 1 : k + size[k]] = False
        best, cps = best[taken], cps[taken]
        lost = np.flatnonzero((best < 0) & (cps != BREAK))
        times = (best >= 0).astype("i8")
        spelled = [self._instead(c) for c in cps[lost].tolist()]
        times[lost] = [len(s) if s else 0 for s in spelled]
        entries = np.repeat(best, times)
        starts = np.cumsum(times) - times
        for at, s in zip(starts[lost].tolist(), spelled):
            if s:
                entries[at : at + len(s)] = s
        table = np.array(self.entries, "f8").reshape(-1, 3)
        code, n, width = table[entries, 0].astype("i8"), table[entries, 1].astype("i8"), table[entries, 2]
        upto = np.cumsum(n)
        raw = np.zeros(int(upto[-1]) if len(upto) else 0, "u1")
        for k in range(4):  # the k-th byte from the end
            has = n > k
            raw[upto[has] - 1 - k] = code[has] >> 8 * k & 255
        data = raw.tobytes()
        stops = starts[cps == BREAK]
        ends = np.concatenate([[0], upto])[stops].tolist()
        firsts = np.concatenate([[0], stops[:-1]])
        widths, spaces = np.concatenate([[0.0], np.cumsum(width)]), np.concatenate([[0], np.cumsum((code == 32) & (n == 1))])
        missing: list[list[str]] = [[] for _ in texts]
        which = np.searchsorted(np.flatnonzero(cps == BREAK), lost)
        for text, c, s in zip(which.tolist(), cps[lost].tolist(), spelled):
            if s is None:
                missing[text].append(chr(c))
        return [
            (data[a:b], float(w), int(m), int(blank), lack)
            for a, b, w, m, blank, lack in zip([0, *ends[:-1]], ends, widths[stops] - widths[firsts], stops - firsts, spaces[stops] - spaces[firsts], missing)
        ]
