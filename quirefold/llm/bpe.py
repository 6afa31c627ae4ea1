"""Byte-level BPE with a hierarchical-bitmap rank queue (operator 8).

The bytes of one or many pre-tokens form a linked list; every adjacent pair of a pre-token that has a merge rank waits
in that rank's bucket. A hierarchical bitmap over the ranks answers "which is the lowest rank with entries" by
find-first-set on each level, so the next bucket costs a few word operations however long the list is; entries made
stale by an earlier merge are skipped when they come up. Positions of one rank are taken from left to right. The result
equals repeated merging of the leftmost pair of lowest rank, in each pre-token.

Texts are split by the pattern into pre-tokens; each is merged on its own. Texts are taken in blocks of bounded size.
Arrow cuts a block at blanks and line ends, where a pre-token always begins unless two white spaces meet (such texts
are cut by the pattern's own rules), and numbers the different pieces; only different words, marks and other pieces are
looked up in the worker's bounded caches, and ids are gathered by number. Decoding gathers the bytes of all ids of a
batch from one table. ``round_trip`` does both in one pass over the workers.

Defined results: null or empty text -> no ids, empty bytes; ids outside the vocabulary are an error; null ids give null;
repeated rows are each answered; other columns, whatever their names, take no part in encoding, and a column named
``decoded`` is replaced by decoding; an empty table gives no rows; no shuffle, whole texts.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import holding, slices
from quirefold.llm.tokens import ChunkCache, gathered


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], shift: int) -> list[list[int]]:
    """Ids of each pre-token; every rank is below ``4 ** shift``.

    The queue is two levels of bitmaps with ``2 ** shift`` bits a word: bit k of a leaf word says that the bucket of
    that rank has entries, bit k of the top word that leaf word k is not zero.
    """
    get, low = ranks.get, (1 << shift) - 1
    whole = [get(p) for p in pieces]
    data = b"".join([p for p, k in zip(pieces, whole) if k is None])
    n = len(data)
    token: list[bytes] = [data[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [get(data[i : i + 2], -1) for i in range(n)]  # the rank under which the pair that starts here waits now; any other entry is stale
    at = 0
    for p, k in zip(pieces, whole):
        if k is None and p:  # no pair reaches over the end of a pre-token
            before[at] = -1
            at += len(p)
            after[at - 1] = waiting[at - 1] = -1
    buckets: dict[int, list[int]] = {}
    leaf: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(waiting):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
    for rank in buckets:
        leaf[rank >> shift] = leaf.get(rank >> shift, 0) | 1 << (rank & low)
        top |= 1 << (rank >> shift)
    dead = bytearray(n)
    while top:
        word = (top & -top).bit_length() - 1
        bits = leaf[word]
        lowest = word << shift | ((bits & -bits).bit_length() - 1)
        leaf[word] = bits = bits & (bits - 1)
        if not bits:
            top &= top - 1
        bucket = buckets.pop(lowest)
        bucket.sort()
        for done, i in enumerate(bucket):
            if waiting[i] != lowest:
                continue
            j = after[i]
            token[i] = merged = token[i] + token[j]
            waiting[j], dead[j] = -1, 1
            after[i] = j = after[j]
            back = False
            waiting[i] = -1
            if j >= 0:
                before[j] = i
                rank = get(merged + token[j])
                if rank is not None:
                    waiting[i] = rank
                    if rank in buckets:
                        buckets[rank].append(i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> shift
                        leaf[word] = leaf.get(word, 0) | 1 << (rank & low)
                        top |= 1 << word
                        back = rank < lowest
            i = before[i]
            if i >= 0:
                rank = get(token[i] + merged, -1)
                waiting[i] = rank
                if rank >= 0:
                    if rank in buckets:
                        buckets[rank].append(i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> shift
                        leaf[word] = leaf.get(word, 0) | 1 << (rank & low)
                        top |= 1 << word
                        back = back or rank < lowest
            if back and done + 1 < len(bucket):  # a lower rank goes first
                buckets[lowest] = bucket[done + 1 :] + buckets.get(lowest, [])
                word = lowest >> shift
                leaf[word] = leaf.get(word, 0) | 1 << (lowest & low)
                top |= 1 << word
                break
    out, at = [], 0
    for p, k in zip(pieces, whole):
        if k is not None:
            out.append([k])
        else:
            stop = at + len(p)
            out.append([ranks[token[i]] for i in range(at, stop) if not dead[i]])
            at = stop
    return out


def merge(piece: bytes, ranks: dict[bytes, int], shift: int) -> list[int]:
    """Ids of one pre-token."""
    return merge_all([piece], ranks, shift)[0]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """``encoded(texts)``: ids of whole texts; ``bytes_of(ids)``: the way back."""

    #: Two white spaces in a row, or one of the characters that mark a piece.
    _RARE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]{2}|[\x01\x02]"
    #: A piece: its lead (none: a blank; 1: a line end; 2: nothing), letters, marks.
    _PLAIN = r"^(?P<lead>[\x01\x02]?)(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]*)(?P<marks>[.,;:!?#*$%&\"()]*)$"
    _CUT = re.compile(r"(?<=\S)(?=[ \n\t])")

    def __init__(self, path: str, pattern: str, limit: int = 200_000):
        import regex

        self.ranks = load_ranks(path)
        self.shift = (max(self.ranks.values()).bit_length() + 1) // 2
        self.pattern = regex.compile(pattern)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), "u1")
        self.token_sizes = np.array([len(t) for t in tokens], "i8")
        self.words = ChunkCache(lambda words: self._merged([w.encode() for w in words]), limit)
        self.others = ChunkCache(self._others, limit // 4)

    def _merged(self, pieces: list[bytes], block: int = 4096) -> list[bytes]:
        """Ids of each pre-token; ``block`` of them share a queue."""
        return [array("I", ids).tobytes() for i in range(0, len(pieces), block) for ids in merge_all(pieces[i : i + block], self.ranks, self.shift)]

    def _others(self, pieces: list[str]) -> list[bytes]:
        parts = [[m.group().encode() for m in self.pattern.finditer(p)] for p in pieces]
        ids = iter(self._merged([x for xs in parts for x in xs]))
        return [b"".join([next(ids) for _ in xs]) for xs in parts]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, ends: text k has ids[ends[k]:ends[k + 1]]); null counts as empty."""
        texts = texts.fill_null("")
        rare = pc.match_substring_regex(texts, self._RARE)
        usual = pc.binary_join_element_wise("\x02", pc.replace_substring(texts.filter(pc.invert(rare)), "\n", " \x01"), "")
        split = pc.split_pattern(usual, " ")
        pieces, ends = split.flatten(), split.offsets.to_numpy().astype("i8")
        cut = [["\x02" + x for x in self._CUT.split(t)] for t in texts.filter(rare).to_pylist()]
        pieces = pa.concat_arrays([pieces, pa.array([x for xs in cut for x in xs], pa.string())])
        ends = np.concatenate([ends - ends[0], ends[-1] - ends[0] + np.cumsum([len(xs) for xs in cut], dtype="i8")])
        ids, n = self._pieces(pieces)
        upto = np.concatenate([np.zeros(1, "i8"), np.cumsum(n)])
        own = np.diff(upto[ends])
        if cut:  # back to the order of the texts
            place = np.argsort(np.argsort(rare.to_numpy(zero_copy_only=False), kind="stable"))
            ids, own = gathered(ids, own, place)
        return ids, np.concatenate([np.zeros(1, "i8"), np.cumsum(own)])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has)."""
        numbered = pieces.dictionary_encode()
        different = numbered.dictionary
        parted = pc.extract_regex(different, pattern=self._PLAIN)
        odd = parted.is_null()
        led = pc.match_substring_regex(different, r"^[\x01\x02]")
        blank = pc.if_else(led, "", " ")
        word, marks = parted.field("word").fill_null(""), parted.field("marks").fill_null("")
        no_word = pc.equal(word, "")
        word = pc.if_else(no_word, "", pc.binary_join_element_wise(blank, word, ""))
        rest = pc.if_else(odd, pc.if_else(led, pc.utf8_slice_codeunits(different, 1), different), marks)
        rest = pc.if_else(no_word, pc.binary_join_element_wise(blank, rest, ""), rest)
        lead = pc.if_else(pc.starts_with(different, "\x01"), "\n", "")
        words, others, leads = word.dictionary_encode(), rest.dictionary_encode(), lead.dictionary_encode()
        own = [x for found, cache in ((leads, self.others), (words, self.words), (others, self.others)) for x in cache.of(found.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, own), "i8", len(own)) // 4
        parts = np.stack([leads.indices.to_numpy(), words.indices.to_numpy() + len(leads.dictionary), others.indices.to_numpy() + len(leads.dictionary) + len(words.dictionary)], axis=1)
        flat, n = gathered(np.frombuffer(b"".join(own), "<u4"), sizes, parts.reshape(-1).astype("i8"))
        return gathered(flat, n.reshape(-1, 3).sum(axis=1), numbered.indices.to_numpy())

    def bytes_of(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, ends: list k has bytes[ends[k]:ends[k + 1]])."""
        found, n = gathered(self.token_bytes, self.token_sizes, ids)
        return found, np.concatenate([np.zeros(1, "i8"), np.cumsum(n)])[ends]

    def ids(self, text: str | None) -> bytes:
        return self.encoded(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def text_bytes(self, ids: list[int]) -> bytes:
        return self.bytes_of(np.array(ids, "i8"), np.array([0, len(ids)]))[0].tobytes()


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One per Python worker and file."""
    holding("bytes", _OPEN.clear)
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids.astype("i4")))


def _binary(found: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("i4")), pa.py_buffer(np.ascontiguousarray(found))])


def _run(docs: DataFrame, path: str, pattern: str, key: str, text: str, back: bool) -> DataFrame:
    source = docs.select(F.col(key), F.col(text).cast("string").alias("_qf_t"))
    names = [key, "ids", "decoded"][: 2 + back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            for part in slices(batch, [1], size=4 << 20):
                ids, ends = codec.encoded(part.column(1))
                cols = [part.column(0), _lists(ids, ends)]
                yield pa.RecordBatch.from_arrays([*cols, _binary(*codec.bytes_of(ids, ends))] if back else cols, names=names)

    kinds = [source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return source.mapInArrow(run, T.StructType(kinds[: 2 + back]))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>; one row per input row."""
    return _run(docs, path, pattern, key, text, False)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, decoded (binary: the bytes that these ids stand for); one row per input row."""
    return _run(docs, path, pattern, key, text, True)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns, then decoded (binary): the bytes that the ids stand for; null ids give null."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            found = _binary(*codec.bytes_of(lists.flatten().to_numpy(), np.concatenate([np.zeros(1, "i8"), np.cumsum(sizes, dtype="i8")])))
            found = pc.if_else(lists.is_valid(), found, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
