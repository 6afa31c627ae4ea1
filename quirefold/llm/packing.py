"""Packing documents into sequences of fixed length by shortest-pack-first over the length histogram (operator 7).

Documents are cut into pieces of ``seq_len`` ids (the last one shorter). Packing looks only at how many pieces there
are of each length: lengths are placed from longest to shortest, each into the shortest pack (the one with most room)
that it fits, by updating how many packs have each pattern; a pattern is a list of lengths. Pieces are then ranked
within their length and joined back to the patterns by rank.

Plan: texts are encoded once and the pieces (with their ids) written to the shared folder, each with the number of
the task that made it and its rank among that task's pieces of the same length. Counts per task and length give, by
sums over the tasks before, the first rank of each task, so ids are never shuffled and no length has a task of its
own, however many pieces share it. These first ranks are broadcast up to ``broadcast_rows`` of them and joined by
(task, length) beyond. The histogram is at most ``seq_len`` numbers, whatever the input; the patterns are broadcast.

Defined results: null or empty text -> a piece of the end id alone; repeated rows are packed as often as they occur
(in the order in which tasks met them); a null key is packed like any other; other columns, whatever their names, take
no part; an empty table gives no rows. Sequences are to be padded to ``seq_len``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import slices, trimmed, written
from quirefold.llm.tokens import END, tokenizer

SEQ_LEN = 4096


def shortest_pack_first(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, list[int]]]:
    """[(how many packs, lengths in the pack)]: all pieces of the histogram, each exactly once."""
    open_packs: list[tuple[int, int, int, list[int]]] = []  # (-room, tie, how many, lengths)
    full: list[tuple[int, list[int]]] = []
    made = 0

    def add(many: int, room: int, lengths: list[int]) -> None:
        nonlocal made
        if many:
            made += 1
            if room:
                heapq.heappush(open_packs, (-room, made, many, lengths))
            else:
                full.append((many, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, many, lengths = heapq.heappop(open_packs)
                used = min(many, left)
                add(many - used, -room, lengths)
                add(used, -room - length, [*lengths, length])
                left -= used
            else:  # new packs; each is the shortest until no more of this length fit
                each = seq_len // length
                add(left // each, seq_len - each * length, [length] * each)
                add(1 if left % each else 0, seq_len - left % each * length, [length] * (left % each))
                left = 0
    return full + [(many, lengths) for _, _, many, lengths in sorted(open_packs)]


class Slots:
    """For each length: from which rank on which sequence and offset, as sorted arrays."""

    def __init__(self, patterns: list[tuple[int, list[int]]], seq_len: int):
        found: dict[int, list[tuple[int, int, int]]] = {}
        ranks = np.zeros(seq_len + 1, "i8")
        sequence = 0
        for many, lengths in patterns:
            offset = 0
            for length in lengths:
                found.setdefault(length, []).append((int(ranks[length]), sequence, offset))
                ranks[length] += many
                offset += length
            sequence += many
        self.by_length = {k: np.array(v, "i8").T.copy() for k, v in found.items()}
        self.sequences = sequence

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, offset = self.by_length[length]
        k = np.searchsorted(first, ranks, "right") - 1
        return sequence[k] + ranks - first[k], offset[k]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the parts of ``values`` that end at ``ends[1:]``; its bytes are below 2 GB."""
    offsets = (ends * values.itemsize).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each piece among those of its length; ``seen`` counts the earlier ones and is brought up to date."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    new = np.flatnonzero(np.diff(ordered, prepend=-1))
    ranks = np.empty(len(length), "i8")
    ranks[order] = np.arange(len(length)) - np.repeat(new, np.diff(np.append(new, len(length)))) + seen[ordered]
    seen += np.bincount(length, minlength=len(seen))
    return ranks


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN) -> DataFrame:
    """doc_id, start, length, doc_tokens, task, rank, ids: 16-bit ids if all of a batch fit, else 32-bit."""

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_qf_t"))
    names = ["doc_id", "start", "length", "doc_tokens", "task", "rank", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = tokenizer(tokenizer_path), TaskContext.get().partitionId(), np.zeros(seq_len + 1, "i8")
        for batch in batches:
            trimmed()
            for part in slices(batch, [1], rows=1000, size=8 << 20):
                ids, ends = words.encoded(part.column(1), END)
                n = np.diff(ends)
                many = -(-n // seq_len)
                doc = np.repeat(np.arange(len(n)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * seq_len
                length = np.minimum(n[doc] - start, seq_len)
                upto = np.append(ends[doc] + start, len(ids))
                packed = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                cols = [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length.astype("i4")), pa.array(n[doc]), pa.array(np.full(len(doc), task, "i8")), pa.array(_ranks(length, seen)), _binary(packed, upto)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return source.mapInArrow(cut, "doc_id bigint, start bigint, length int, doc_tokens bigint, task bigint, rank bigint, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bit): one row per piece."""
    rows = written(pieces(docs, tokenizer_path, key, text, seq_len), "pieces")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(rows.groupBy("task", "length").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    shipped = docs.sparkSession.sparkContext.broadcast(Slots(shortest_pack_first(histogram, seq_len), seq_len))
    first = counts.select("task", "length", "first")
    ranked = rows.join(F.broadcast(first) if first.count() <= broadcast_rows else first, ["task", "length"])
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shipped.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                col = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                length, rank = col("length").to_numpy(), col("rank").to_numpy()
                sequence, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
                for k in np.unique(length):
                    at = np.flatnonzero(length == k)
                    sequence[at], offset[at] = slots.place(int(k), rank[at])
                ids = [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(col("ids").to_pylist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([col("doc_id"), col("start"), pa.array(length.astype("i8")), col("doc_tokens"), pa.array(sequence), pa.array(offset), pa.array(ids, pa.binary())], names=names)

    placed = ranked.select("doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("rank")).alias("rank"), "ids")
    return placed.mapInArrow(place, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
