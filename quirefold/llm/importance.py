"""Importance resampling towards a target text by hashed n-grams (operator 13).

Features of a text are all runs of one to three words, hashed into buckets by CRC. A bucket's gain is the logarithm of
its smoothed frequency in the target texts over that in the raw ones; a document's weight is the sum of the gains of
its features. Documents are drawn without replacement by Gumbel noise on top of the weight: the highest scores win.

Words come from the ``tokenizers`` library's untrained Regex Split over the lower-cased (A to Z) text, with offsets. It
sees the different blank-separated chunks of a block of texts, as one text whose offsets tell which chunk a word is of,
and chunks seen before come from a bounded cache; blanks and line feeds separate words anyway. The split runs over UTF-8
bytes read as Latin-1: every byte of a character beyond ASCII belongs to a word, so words are the same and offsets are
those of bytes. A window of two or three words, from the first one's start to the last one's end and joined by one
space, gets its CRC from those of its parts, since crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where the shift is
linear: four table look-ups, made for all windows of a block at once.

Plan: two passes over the texts, both without a shuffle of anything that grows with a text. The first sends one
histogram a task; the sums, at most ``buckets`` rows, are read by the driver, which makes the gains and sends them out
(80 kB). The second gives a row a document, which is written. Ranks are a running count in order of score over ranges
of documents (``totals.running``), so no task sorts them all.

Defined results: null text has no words; documents without features have weight 0 and are scored, too; only those with
``min_words`` words or more are drawn; null id: hashed as an empty one, behind all others among equal scores; rows with
equal ids are documents of their own; a long text is split in parts of about ``PART`` bytes, cut between words, and its
features still run over the cuts; an empty target leaves gains from the raw counts alone; an empty table: no rows;
other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import holding, slices, written
from quirefold.llm.tokens import ChunkCache, gathered
from quirefold.llm.totals import running

#: What separates words, as a class of bytes.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Bytes of text that are split at once.
PART = 1 << 20


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """What one byte adds to a CRC; by linearity that is the difference of two CRCs of one byte."""
    return np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], "u4")


@lru_cache(maxsize=1)
def _short_shifts() -> np.ndarray:
    """[bytes, which byte of the CRC, its value] -> that part of the CRC after so many zero bytes, below 64."""
    step, tables = _crc_table(), np.empty((64, 4, 256), "u4")
    for k in range(4):
        tables[0, k] = np.arange(256, dtype="u4") << np.uint32(8 * k)
    for n in range(63):
        tables[n + 1] = step[tables[n] & np.uint32(255)] ^ (tables[n] >> np.uint32(8))
    return tables


def _moved(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0, crc & np.uint32(255)]
    for k in range(1, 4):
        out ^= tables[k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@lru_cache(maxsize=64)
def _long_shift(power: int) -> np.ndarray:
    """The tables of a shift by ``2 ** power`` bytes, 64 at least."""
    half = _short_shifts()[32] if power == 6 else _long_shift(power - 1)
    return np.stack([_moved(half[k], half) for k in range(4)])


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``crc`` (uint32) as it is after ``by`` zero bytes."""
    tables, low = _short_shifts(), by & 63
    out = tables[low, 0, crc & np.uint32(255)]
    for k in range(1, 4):
        out ^= tables[low, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    left, power = by >> 6, 6
    while left.any():
        at = np.flatnonzero(left & 1)
        out[at] = _moved(out[at], _long_shift(power))
        left, power = left >> 1, power + 1
    return out


class Splitter:
    """The words of texts, as CRC and length, and the buckets of their windows."""

    def __init__(self, buckets: int = 10_000, most: int = 400_000):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(APART + "+"), behavior="removed").pre_tokenize_str
        self.apart = re.compile(APART.encode())
        self.buckets, self.chunks = buckets, ChunkCache(self._learn, most)

    def parts(self, raw: bytes) -> Iterator[tuple[int, str]]:
        """``raw`` as Latin-1 in parts of about PART bytes that end between words, each with its place."""
        at = 0
        while at < len(raw):
            stop = at + PART
            if stop < len(raw):
                end = self.apart.search(raw, stop)
                stop = end.start() if end else len(raw)
            yield at, raw[at:stop].decode("latin-1")
            at = stop

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """CRC << 32 | length of the words of each chunk: all chunks are split as one text, and offsets tell whose they are."""
        each = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, each), "i8", len(each)) + 1
        begins, words, starts = np.cumsum(sizes) - sizes, [np.zeros(0, "u8")], [np.zeros(0, "i8")]
        for at, part in self.parts(b" ".join(each)):
            pairs = self.split(part)
            raw = [word.encode("latin-1") for word, _ in pairs]
            words.append(np.fromiter((zlib.crc32(w) << 32 | len(w) for w in raw), "u8", len(raw)))
            starts.append(np.fromiter((start for _, (start, _) in pairs), "i8", len(pairs)) + at)
        words = np.concatenate(words)
        ends = np.cumsum(np.bincount(np.searchsorted(begins, np.concatenate(starts), "right") - 1, minlength=len(each)))
        return [x.tobytes() for x in np.split(words, ends[:-1])]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(CRC << 32 | length of the words of all texts, how many each text has)."""
        plain = pc.ascii_lower(texts.fill_null(""))
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        own = self.chunks.of(numbered.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), "i8", len(own)) // 8
        words, n = gathered(np.frombuffer(b"".join(own), "u8"), sizes, numbered.indices.to_numpy())
        upto, ends = np.concatenate([np.zeros(1, "i8"), np.cumsum(n)]), split.offsets.to_numpy()
        return words, np.diff(upto[ends - ends[0]])

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, bucket of every feature of all texts, the text it belongs to)."""
        words, counts = self.words(texts)
        of = np.repeat(np.arange(len(texts)), counts)
        crc, size = (words >> np.uint64(32)).astype("u4"), (words & np.uint64(0xFFFFFFFF)).astype("i8")
        found, owners, last = [crc % np.uint32(self.buckets)], [of], crc
        for n in (1, 2):  # windows of n words are continued by a space and the next word
            if len(words) <= n:
                break
            fits, head = of[n:] == of[:-n], ~last[: len(words) - n]
            spaced = ~(_crc_table()[(head ^ np.uint32(32)) & np.uint32(255)] ^ (head >> np.uint32(8)))
            last = shifted(spaced, size[n:]) ^ crc[n:]
            found.append(last[fits] % np.uint32(self.buckets))
            owners.append(of[n:][fits])
        return counts, np.concatenate(found), np.concatenate(owners)


_OPEN: dict[int, Splitter] = {}


def _splitter(buckets: int) -> Splitter:
    """One per Python worker."""
    holding("features", _OPEN.clear)
    if buckets not in _OPEN:
        _OPEN[buckets] = Splitter(buckets)
    return _OPEN[buckets]


def histogram(texts: DataFrame, text: str = "text", buckets: int = 10_000) -> np.ndarray:
    """How many features all texts have in each bucket; one partial histogram a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = _splitter(buckets), np.zeros(buckets, "i8")
        for batch in batches:
            for part in slices(batch, [0], rows=5000, size=8 << 20):
                total += np.bincount(own.features(part.column(0))[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, "i8")
    for row in counted.collect():  # at most `buckets` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to raw) of each bucket, in doubles."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist())], "i8")


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document; no shuffle."""
    shipped, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 8)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"), h.alias("h"))

    def noise(hexed: str) -> int:
        return math.floor(-1000 * math.log(-math.log((int(hexed, 16) + 0.5) / 4294967296)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _splitter(buckets)
        for batch in batches:
            for part in slices(batch, [1], rows=5000, size=8 << 20):
                words, found, of = own.features(part.column(1))
                # sums of integers below 2 ** 53 are exact in doubles
                weight = np.bincount(of, weights=shipped.value[found], minlength=part.num_rows).astype("i8")
                score = weight + np.array([noise(x) for x in part.column(2).to_pylist()], "i8")
                columns = [part.column(0), pa.array(words), pa.array(np.bincount(of, minlength=part.num_rows)), pa.array(weight), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    schema = source.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long").add("score", "long")
    return source.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null if not drawn) of each document.

    ``percent`` of the documents with at least ``min_words`` words are drawn, rounded down.
    """
    gain = gains(histogram(docs, text, buckets), histogram(target, target_text, buckets))
    scored = written(weigh(docs, gain, key, text, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= min_words
    drawn = scored.agg(F.count(F.when(fit, 1))).first()[0] * percent // 100
    order = [(~fit).cast("int"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = running(scored, order, {"above": F.lit(1).cast("long")}, "ranks")
    rank = F.when(fit & (F.col("above") < drawn), F.col("above") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
