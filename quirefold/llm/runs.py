"""Periodic runs of words: finding every one and collapsing it to its first period (operator 12).

A run is a stretch of words with smallest period q, q words apart identical, at least ``max(24, 3 q)`` long, that no
neighbouring word extends. Per text, at dyadic scales: the text is cut in blocks of B words; an exact integer
convolution (number-theoretic transform) of squared differences of word numbers gives the distances of B to 2 B at which
a block occurs again in the window behind it, without mismatch; each distance seeds a stretch that is extended both
ways. A run of period q >= 8 holds a whole block of the largest B <= q, and its next occurrence; a shorter period is found
with B = 8, whose window begins right behind the block's first word, since a run has 24 words at least.

A block is transformed only if it can matter: each of its grams of eight words occurs again less than 2 B words later
(grams are compared by hash, so a clash costs time, nothing else), and no known run of a period up to B covers the block
and its windows, for then every distance is a multiple of that period. Distances are checked word by word and extended
for all seeds of a scale at once, by numbered grams of 1, 2, 4, 8... words (prefix doubling), so a text of n words takes
O(n log^2 n) steps however it repeats. Of seeds with the same stretch the least distance is its period: the smallest
period of a stretch of three periods divides all shorter ones, and its own run ends where the stretch does.

Plan: one Arrow pass over the texts, no shuffle; a task holds a slice of texts of bounded size, or one long text.

Defined results: null and empty texts have no words: no runs, the digests of an empty string; null ids leave the text
unmodified; ids of any type count by their decimal or other text; equal greatest exponents: smallest start, then period;
repeated rows: each gets its own; an empty table: no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirefold.llm.common import slices

#: Least words and periods of a run.
LEAST, PERIODS = 24, 3
#: Words of the smallest block, a power of two: 2 * BASE - 1 + q <= max(LEAST, PERIODS * q) for q <= BASE.
BASE = 8
#: Prime of the transform, 119 * 2 ** 23 + 1, and a generator of its units.
PRIME, ROOT = 998_244_353, 3
#: Numbers that are transformed at once.
_AT_ONCE = 1 << 19


@lru_cache(maxsize=32)
def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each halving of a transform of ``size``, largest first."""
    out = []
    while size > 1:
        w = pow(ROOT, (PRIME - 1) // size, PRIME)
        w, powers = pow(w, PRIME - 2, PRIME) if inverse else w, np.ones(1, "i8")
        while len(powers) < size // 2:
            powers = np.concatenate([powers, powers * pow(w, len(powers), PRIME) % PRIME])
        out.append(powers)
        size //= 2
    return out


def transformed(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order; entries are below PRIME, a row's length is a power of two."""
    many, size = rows.shape
    out = rows
    for w in _twiddles(size, False):
        halves = out.reshape(many, -1, 2, len(w))
        a, b = halves[:, :, 0], halves[:, :, 1]
        out = np.stack([(a + b) % PRIME, (a - b) % PRIME * w % PRIME], axis=2).reshape(many, size)
    return out


def untransformed(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transformed``."""
    many, size = rows.shape
    out = rows
    for w in reversed(_twiddles(size, True)):
        halves = out.reshape(many, -1, 2, len(w))
        a, b = halves[:, :, 0], halves[:, :, 1] * w % PRIME
        out = np.stack([(a + b) % PRIME, (a - b) % PRIME], axis=2).reshape(many, size)
    return out * pow(size, PRIME - 2, PRIME) % PRIME


def occurrences(words: np.ndarray, starts: np.ndarray, block: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, distances) of all places from ``nearest`` to below ``2 * block`` behind a block's start, all words inside
    the text, at which the squared differences of the block's words (numbers from 1) sum up to 0."""
    wide = 2 * block - nearest  # distances
    size = 1 << (wide + block - 2).bit_length()
    found_s, found_d = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    padded = np.concatenate([words, np.zeros(3 * block, "i8")])  # no word has number 0
    for k in range(0, len(starts), max(1, _AT_ONCE // size)):
        at = starts[k : k + max(1, _AT_ONCE // size), None]
        x = padded[at + np.arange(block)] % PRIME
        y = padded[at + nearest + np.arange(wide + block - 1)] % PRIME
        fx, fy = np.zeros((len(at), size), "i8"), np.zeros((len(at), size), "i8")
        fx[:, :block], fy[:, : wide + block - 1] = x[:, ::-1], y
        both = untransformed(transformed(fx) * transformed(fy) % PRIME)[:, block - 1 : block - 1 + wide]
        squares = np.concatenate([np.zeros((len(at), 1), "i8"), np.cumsum(y * y % PRIME, axis=1)], axis=1)
        own = (x * x % PRIME).sum(axis=1, keepdims=True)
        r, d = np.nonzero((own + squares[:, block:] - squares[:, :wide] - 2 * both) % PRIME == 0)
        d = d + nearest
        inside = at[r, 0] + d + block <= len(words)
        found_s.append(at[r, 0][inside])
        found_d.append(d[inside])
    return np.concatenate(found_s), np.concatenate(found_d)


class Grams:
    """Numbers of the grams of 1, 2, 4... words at each place; how far two places agree, forwards and backwards."""

    def __init__(self, words: np.ndarray):
        self.levels, n = [words], len(words)
        while 1 << len(self.levels) <= n:  # so no agreement is twice the longest gram
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.unique(last[:-step] * (n + 1) + last[step:], return_inverse=True)[1].astype("i8"))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that begin at ``a`` and at ``b``, a < b."""
        out = np.zeros(len(a), "i8")
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            i, j = a + out, b + out
            fits = j < len(level)
            same = np.zeros(len(a), bool)
            same[fits] = level[i[fits]] == level[j[fits]]
            out[same] += 1 << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that end right before ``a`` and ``b``, a < b."""
        out = np.zeros(len(a), "i8")
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            i, j = a - out - (1 << k), b - out - (1 << k)
            fits = i >= 0
            same = np.zeros(len(a), bool)
            same[fits] = level[i[fits]] == level[j[fits]]
            out[same] += 1 << k
        return out


def _next_gram(words: np.ndarray, gram: int = BASE) -> np.ndarray:
    """For each gram's place, how far away the next equal one begins; far beyond the text if there is none."""
    n, far = len(words) - gram + 1, 4 * len(words)
    codes = np.zeros(n, "u8")
    for k in range(gram):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype("u8")
        codes ^= codes >> np.uint64(29)
    order = np.argsort(codes, kind="stable")
    same, out = codes[order[1:]] == codes[order[:-1]], np.full(n, far, "i8")
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def runs(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, by start, then period; ``words`` are numbers from 1, one a different word."""
    n = len(words)
    none = np.zeros((0, 3), "i8")
    if n < LEAST:
        return none
    gap = _next_gram(words)
    if int(gap.min()) >= n:
        return none
    grams, known, block = None, none, BASE
    while PERIODS * block <= n:
        starts = np.arange(0, n - block + 1, block)
        # all grams inside the block occur again in time
        near = np.concatenate([[0], np.cumsum(gap < 2 * block)])
        starts = starts[near[starts + block - BASE + 1] - near[starts] == block - BASE + 1]
        if len(known):
            covers = known[known[:, 2] <= block]
            k = np.searchsorted(covers[:, 0], starts, "right")
            reach = np.concatenate([[0], np.maximum.accumulate(covers[:, 0] + covers[:, 1])])[k]
            starts = starts[reach < np.minimum(starts + 3 * block, n)]
        if len(starts):
            at, far = occurrences(words, starts, block, 1 if block == BASE else block)
            grams = grams or Grams(words)
            ahead, behind = grams.forward(at, at + far), grams.backward(at, at + far)
            found = np.stack([at - behind, ahead + behind + far, far], axis=1)
            found = found[(ahead >= block) & (found[:, 1] >= np.maximum(LEAST, PERIODS * far))]
            known = np.concatenate([known, found])
            known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
            known = known[np.append(True, (np.diff(known[:, :2], axis=0) != 0).any(axis=1))[: len(known)]]
        block *= 2
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def greatest(found: np.ndarray) -> tuple[int, int, int]:
    """The run with the greatest length / period; ties: smallest start, then period."""
    ratio = found[:, 1] / found[:, 2]
    close = found[ratio >= ratio.max() * (1 - 1e-9)].tolist()
    best = close[0]
    for one in close[1:]:
        ahead = one[1] * best[2] - best[1] * one[2]
        if ahead > 0 or (ahead == 0 and (one[0], one[2]) < (best[0], best[2])):
            best = one
    return tuple(best)


def repeated(n: int, doc: str | None) -> np.ndarray | None:
    """Places of the words that a text of ``n`` words gets if its id makes it a repetitive one; None: as it is."""
    h = zlib.crc32(doc.encode()) if doc is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1
        return found


def _one(doc: str | None, text: str | None, modify: bool) -> tuple:
    words, numbers = (text or "").encode().split(), _Numbers()
    places = repeated(len(words), doc) if modify else None
    ids = np.fromiter(map(numbers.__getitem__, words), "i8", len(words))
    if places is not None:
        ids = ids[places]
        words = [words[k] for k in places.tolist()]
    found = runs(ids)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    top = (None,) * 4
    if len(found):
        s, n, q = greatest(found)
        top = (s, n, q, 1000 * n // q)
        edge = np.zeros(len(words) + 1, "i8")
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 0] + found[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return (len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), b" ".join(words).decode(), found)


LONGS = ("n_runs", "start", "length", "period", "exponent_milli")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", modify: bool = False) -> DataFrame:
    """doc_id; n_runs; start, length, period and exponent_milli of the run with the greatest exponent (null if there is
    none); runs_sha256; runs (start, length, period of each); collapsed (the words outside all but the first periods of
    runs, joined by one space). ``modify`` makes one id in ten repetitive first, see ``repeated``."""
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{key}`").cast("string").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, [2], size=8 << 20):
                rows = [_one(d, t, modify) for d, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                columns = [part.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]]
                columns += [pa.array([r[5] for r in rows], pa.string()), pa.array([[dict(zip(("start", "length", "period"), x)) for x in r[7].tolist()] for r in rows], pa.list_(triple)), pa.array([r[6] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *LONGS, "runs_sha256", "runs", "collapsed"])

    more = StructType.fromDDL(", ".join(f"{n} bigint" for n in LONGS) + ", runs_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return source.mapInArrow(run, StructType([*source.select("doc_id").schema, *more]))
