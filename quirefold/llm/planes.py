"""Token ids in a bit-plane-shuffled binary format (operator 9), as a Spark data source named ``qf_planes``.

A data set is a folder: one file per writing task and ``index.json``, which the driver writes last and which names
the files of the committed tasks in document order, with their numbers of ids; files of lost or repeated task
attempts are in no index and are ignored.

A file: the magic bytes, then blocks. A block holds ``BLOCK`` ids (the last one fewer) as unsigned 32-bit integers,
transposed to 4 byte planes or 32 bit planes, each compressed with zstandard on its own. Then come the documents
(keys and numbers of ids, an Arrow stream, compressed), the chunk index (offset and length of every plane of every
block, JSON, compressed), its length, and the magic bytes again. With the chunk index any range of ids can be read
without the blocks before it.

Documents are range-partitioned by key and hash of the text, so the files in index order hold them in ascending order
of keys and the start of a document is the number of ids before it.

Defined results: null or empty text -> the end id alone; null key sorts first; equal keys are ordered by the hash of
their texts, so copies of one row stand together; other columns, whatever their names, are not stored; an empty table
gives a data set without files, which reads as no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quirefold.llm.common import scratch, slices
from quirefold.llm.tokens import END, tokenizer

MAGIC = b"QFPLANE1"
#: Ids in a block.
BLOCK = 1 << 16
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block: byte k of every id, or bit k of every id (32 planes, eight ids a byte)."""
    octets = np.ascontiguousarray(ids.astype("<u4").view("u1").reshape(-1, 4).T)
    if not bits:
        return [row.tobytes() for row in octets]
    return [np.packbits(octets[k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((4, n), "u1")
    for k, plane in enumerate(planes):
        row = np.frombuffer(plane, "u1")
        if len(planes) == 4:
            out[k] = row
        else:
            out[k // 8] |= np.unpackbits(row, count=n, bitorder="little") << (k % 8)
    return np.ascontiguousarray(out.T).view("<u4").reshape(-1)


class PlaneFile:
    """Writes one file to an open binary stream."""

    def __init__(self, out, bits: bool = False, level: int = 1):
        self.out, self.bits, self.packer = out, bits, zstandard.ZstdCompressor(level=level)
        self.at, self.blocks, self.rest, self.held = len(MAGIC), [], [], 0
        self.keys: list[pa.Array] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        entry = {"n": len(ids), "planes": []}
        for plane in to_planes(ids, self.bits):
            packed = self.packer.compress(plane)
            entry["planes"].append([self.at, len(packed)])
            self.out.write(packed)
            self.at += len(packed)
        self.blocks.append(entry)

    def add(self, keys: pa.Array, ids: list[bytes]) -> None:
        self.add_all(keys, np.frombuffer(b"".join(ids), "<u4"), [len(x) // 4 for x in ids])

    def add_all(self, keys: pa.Array, ids: np.ndarray, counts: list[int]) -> None:
        """Documents with their ids one behind another and the number of ids of each."""
        self.keys.append(keys)
        self.counts += counts
        self.rest.append(ids.tobytes())
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        upto = len(ids) if all_of_it else len(ids) - len(ids) % BLOCK
        for i in range(0, upto, BLOCK):
            self._block(ids[i : min(i + BLOCK, upto)])
        self.rest, self.held = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> int:
        """The number of ids in the file."""
        self._flush(True)
        docs = pa.RecordBatch.from_arrays([pa.concat_arrays(self.keys or [pa.array([], pa.int64())]), pa.array(self.counts, pa.int64())], names=["key", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as stream:
            stream.write_batch(docs)
        packed = self.packer.compress(sink.getvalue().to_pybytes())
        self.out.write(packed)
        index = self.packer.compress(json.dumps({"bits": self.bits, "docs": [self.at, len(packed)], "blocks": self.blocks}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return sum(self.counts)


class PlaneReader:
    """Reads one file from a random-access stream, block by block."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file, or one that was cut off")
        length = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(self.unpack.decompress(source.read_at(length, size - 16 - length)))

    def documents(self) -> pa.RecordBatch:
        at, n = self.index["docs"]
        with pa.ipc.open_stream(self.unpack.decompress(self.source.read_at(n, at))) as stream:
            return stream.read_all().combine_chunks().to_batches()[0] if stream.schema else None

    def block(self, k: int) -> np.ndarray:
        entry = self.index["blocks"][k]
        first, (last, n) = entry["planes"][0][0], entry["planes"][-1]
        raw = self.source.read_at(last + n - first, first)
        return from_planes([self.unpack.decompress(raw[at - first : at - first + size]) for at, size in entry["planes"]], entry["n"])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Any range of ids, reading only its blocks."""
        parts = [self.block(k) for k in range(start // BLOCK, -(-(start + n) // BLOCK))]
        return np.concatenate(parts)[start % BLOCK :][:n] if parts else np.array([], "<u4")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """A path or URI of any store that Arrow knows (local, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Wrote(WriterCommitMessage):
    partition: int
    file: str
    n_ids: int
    n_docs: int


@dataclass
class PlanePart(InputPartition):
    file: str
    base: int


class PlanesSource(DataSource):
    """Options: path, bits (true: 32 bit planes; default: 4 byte planes), tokenizer (a file: rows to write hold texts)."""

    @classmethod
    def name(cls) -> str:
        return "qf_planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "PlanesReader":
        return PlanesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> "PlanesWriter":
        return PlanesWriter(self.options["path"], self.options.get("bits", "false") == "true", self.options.get("tokenizer"))


class PlanesWriter(DataSourceArrowWriter):
    """Takes rows (doc_id, ids), or (doc_id, text) with a tokenizer, in the order in which they are to be stored.

    Texts are encoded here and not in a stage before, so that a task needs one Python worker and not two.
    """

    def __init__(self, path: str, bits: bool, tokenizer: str | None = None):
        self.path, self.bits, self.tokenizer = path, bits, tokenizer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        file = f"part-{number:06d}-{uuid.uuid4().hex}.qfp"
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{file}", compression=None) as out:
            target = PlaneFile(out, self.bits)
            for batch in iterator:
                if self.tokenizer:
                    for part in slices(batch, [batch.schema.get_field_index("text")]):
                        ids, ends = tokenizer(self.tokenizer).encoded(part.column("text"), END)
                        target.add_all(part.column("doc_id").cast(pa.int64()), ids, np.diff(ends).tolist())
                else:
                    for i in range(0, batch.num_rows, 1000):
                        part = batch.slice(i, 1000)
                        target.add(part.column("doc_id").cast(pa.int64()), part.column("ids").to_pylist())
            n = target.close()
        return Wrote(number, file, n, len(target.counts))

    def commit(self, messages: list[Wrote | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        with store.open_output_stream(f"{folder}/index.json", compression=None) as out:
            out.write(json.dumps({"files": [{"file": m.file, "n_ids": m.n_ids, "n_docs": m.n_docs} for m in done if m.n_docs]}).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        """Files without an index are ignored by readers."""


class PlanesReader(DataSourceReader):
    """Rows of a data set: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32 bit)."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[PlanePart]:
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/index.json", compression=None) as source:
            files = json.loads(source.read())["files"]
        bases = np.cumsum([0, *(f["n_ids"] for f in files)]).tolist()
        return [PlanePart(f["file"], base) for f, base in zip(files, bases)]

    def read(self, partition: PlanePart) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, PlanePart):
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as source:
            reader = PlaneReader(source)
            docs = reader.documents()
            counts = docs.column("n").to_numpy()
            ends = np.cumsum(counts)
            held, done, block, i = np.array([], "<u4"), 0, 0, 0  # ids from position ``done`` on that are decoded
            while i < len(counts):
                j = i
                while block < len(reader.index["blocks"]) and done + len(held) < ends[i] or block < len(reader.index["blocks"]) and len(held) < 4 * BLOCK:
                    held = np.concatenate([held, reader.block(block)])
                    block += 1
                while j < len(counts) and ends[j] <= done + len(held):
                    j += 1
                starts = ends[i:j] - counts[i:j]
                ids = [held[a - done : b - done].tobytes() for a, b in zip(starts, ends[i:j])]
                yield pa.RecordBatch.from_arrays([docs.column("key").slice(i, j - i), pa.array(starts + partition.base, pa.int64()), pa.array(counts[i:j], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                held, done, i = held[ends[j - 1] - done :], int(ends[j - 1]), j


def write(docs: DataFrame, tokenizer_path: str, out: str, key: str = "doc_id", text: str = "text", bits: bool = False) -> None:
    """Encode ``docs`` and write them to the folder ``out`` in ascending key order.

    Ranges are cut by (key, hash of the text), so that rows of one key, or without one, may be many tasks' work.
    """
    docs.sparkSession.dataSource.register(PlanesSource)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.write.format("qf_planes").option("path", out).option("bits", str(bits).lower()).option("tokenizer", tokenizer_path).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of a data set that ``write`` made."""
    spark.dataSource.register(PlanesSource)
    return spark.read.format("qf_planes").option("path", path).load()


def round_trip(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", bits: bool = False) -> DataFrame:
    """Written to the shared folder and read back from there."""
    out = scratch(docs.sparkSession, "planes")
    write(docs, tokenizer_path, out, key, text, bits)
    return read(docs.sparkSession, out)
