"""PDF files as a source of page streams and as a sink.

Reading: ``spark.read.format("binaryFile")`` gives one row per file; one narrow Python stage turns each file into
its pages. A file that can't be read becomes a row with a warning, never a failure. Writing: ``patched`` puts edited
pages and forms behind a file's own bytes, as an update that leaves all else as it is; ``documents`` makes new files of
text pages, grouped by document (a document's pages must fit one task). Files are written by a data source to any store
that Arrow knows, and are there all at once, when the job has committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quirefold.functions.geometry import quarter_turns
from quirefold.functions.pdfobjects import PdfFile, Refused, build_pdf
from quirefold.functions.pdfupdate import page_nodes, references, updated
from quirefold.operators.graph import released

PAGES = (
    "doc_id bigint, page_index int, content binary, fonts map<string,string>, forms map<string,struct<content:binary,matrix:array<double>,key:string,fonts:map<string,string>,names:map<string,string>>>, media array<double>, crop array<double>, "
    "rotate double, warning string, spaces map<string,string>, signed boolean, issues array<string>, states map<string,struct<size:double,named:boolean>>, properties map<string,string>"
)


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, content of the PDF files of a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"(?i)\.pdf$"))
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def pages(documents: DataFrame) -> DataFrame:
    """One row per page, or one with a warning (encrypted, parse, empty) and no page index; documents: doc_id, content."""
    names = [c.strip().split(" ")[0] for c in ("doc_id", "page_index", "content", "fonts", "forms", "media", "crop", "rotate", "warning", "spaces", "signed", "issues", "states", "properties")]

    def box(file: PdfFile, page: dict, key: bytes) -> list[float] | None:
        value = file.get(page.get(key))
        value = [file.get(v) for v in value] if isinstance(value, list) else []
        return value if len(value) == 4 and all(isinstance(v, float) for v in value) else None

    def read(doc: int, content: bytes) -> Iterator[tuple]:
        try:
            file = PdfFile.parse(content or b"")
            for k, page in enumerate(file.pages()):
                fonts, forms = file.resources(page)
                states = file.states_of(page)
                fonts |= {f"gs:{name}": spec for name, (_, spec) in states.items() if spec}
                rotate = file.get(page.get(b"Rotate"))
                yield doc, k, file.page_content(page), fonts, forms, box(file, page, b"MediaBox"), box(file, page, b"CropBox"), rotate if isinstance(rotate, float) else None, None, file.spaces_of(page), file.signed(), [] if file.decodable(page) else ["content-decode"], {n: {"size": size, "named": spec is not None} for n, (size, spec) in states.items()}, file.actual_texts(page)
        except Refused as why:
            yield doc, None, None, None, None, None, None, None, why.code, *[None] * 5
        except Exception:  # noqa: BLE001  a broken file is a warning, not a failed job
            yield doc, None, None, None, None, None, None, None, "parse", *[None] * 5

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for doc, content in zip(batch["doc_id"], batch["content"]) for row in read(doc, content)]
            frame = pd.DataFrame(out, columns=names)
            frame["page_index"] = frame["page_index"].astype("Int32")
            yield frame

    return documents.select("doc_id", "content").mapInPandas(rows, PAGES)


def page_geometry(found: DataFrame) -> DataFrame:
    """width, height, rotation, offset_x, offset_y, display_width, display_height: the crop box within the media box."""

    def box(c: str) -> tuple[Column, Column, Column, Column]:
        b = lambda k: F.get(c, F.lit(k))
        return F.least(b(0), b(2)), F.least(b(1), b(3)), F.greatest(b(0), b(2)), F.greatest(b(1), b(3))

    media = [F.coalesce(v, F.lit(float(d))) for v, d in zip(box("media"), (0, 0, 612, 792))]
    crop = box("crop")
    cut = [F.greatest(media[0], crop[0]), F.greatest(media[1], crop[1]), F.least(media[2], crop[2]), F.least(media[3], crop[3])]
    usable = F.col("crop").isNotNull() & (cut[2] > cut[0]) & (cut[3] > cut[1])
    x0, y0, x1, y1 = (F.when(usable, c).otherwise(m) for c, m in zip(cut, media))
    turned = F.col("rotation").isin(90, 270)
    return found.select(
        "doc_id", "page_index", (x1 - x0).alias("width"), (y1 - y0).alias("height"), quarter_turns(F.col("rotate")).cast("int").alias("rotation"), x0.alias("offset_x"), y0.alias("offset_y")
    ).withColumns({"display_width": F.when(turned, F.col("height")).otherwise(F.col("width")), "display_height": F.when(turned, F.col("width")).otherwise(F.col("height"))})


def stream_object(key: Column) -> Column:
    """struct<number,generation> of the object that a stream key of a form names; null for pages and inline forms."""
    part = lambda k: F.regexp_extract(key, r"^xobj:(\d+) (\d+) R$", k).cast("int")
    return F.when(key.rlike(r"^xobj:\d+ \d+ R$"), F.struct(part(1).alias("number"), part(2).alias("generation")))


def source_of(content: Column) -> Column:
    """Page content as text, byte by byte."""
    return F.decode(content, "ISO-8859-1")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` by document in a fixed number of parts, as Spark would join small parts of what compresses well into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "doc_id")


def documents(streams: DataFrame, compress: bool = True) -> DataFrame:
    """doc_id, content: one file per document from its page streams (doc_id, page_index, content and, if there, fonts)."""
    own = "fonts" in streams.columns
    listed = _dealt(streams).groupBy("doc_id").agg(F.collect_list(F.struct("page_index", "content", *(["fonts"] if own else []))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                ordered = sorted(batch.column(1).slice(k, 1).to_pylist()[0], key=lambda p: (p["page_index"] is None, p["page_index"]))
                file = build_pdf([p["content"] for p in ordered], compress, fonts=[dict(p["fonts"] or []) for p in ordered] if own else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([file], pa.binary())], names=["doc_id", "content"])

    return listed.mapInArrow(run, "doc_id bigint, content binary")


def object_references(found: DataFrame) -> DataFrame:
    """doc_id, from, to, key: one row for each reference from one object of a file to another; of a page's Contents, key is
    /Contents. Objects of files that can't be read have none; found: doc_id, content."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    objects = PdfFile.parse(content or b"").objects
                except Refused:
                    continue
                listed = [(doc, n, to, key) for n, value in objects.items() for key, to in references(value)]
                yield pd.DataFrame(listed, columns=["doc_id", "from", "to", "key"])

    return found.select("doc_id", "content").mapInPandas(rows, "doc_id bigint, from bigint, to bigint, key string")


def page_objects(found: DataFrame) -> DataFrame:
    """doc_id, page_index, node: the object of each page."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    listed = [(doc, k, ref.number) for k, (ref, _, _) in enumerate(page_nodes(PdfFile.parse(content or b""))) if ref]
                except Refused:
                    continue
                yield pd.DataFrame(listed, columns=["doc_id", "page_index", "node"])

    return found.select("doc_id", "content").mapInPandas(rows, "doc_id bigint, page_index int, node bigint")


def unused_contents(found: DataFrame, replaced: DataFrame) -> DataFrame:
    """doc_id, to: content streams (and lists of them) that only replaced pages show; replaced: doc_id, page_index.

    A page may name one stream, a list in place, or a list that is an object of its own: such lists are followed.
    """
    edges = object_references(found).withColumnRenamed("from", "source")
    nodes = page_objects(found)
    mark = replaced.select("doc_id", "page_index").distinct().withColumn("gone", F.lit(True))
    pages_of = nodes.join(mark, ["doc_id", "page_index"], "left").select("doc_id", F.col("node").alias("source"), F.coalesce("gone", F.lit(False)).alias("gone"))
    direct = edges.where("key = '/Contents'").join(pages_of, ["doc_id", "source"]).select("doc_id", "gone", "to")
    listed = edges.where("key = ''").select("doc_id", F.col("source").alias("to"), F.col("to").alias("inner"))  # arrays that are objects
    inner = direct.join(listed, ["doc_id", "to"]).select("doc_id", "gone", F.col("inner").alias("to"))
    shown = direct.union(inner)
    elsewhere = edges.where("key != '/Contents' and key != ''").select("doc_id", "to")  # links and the like keep an object, too
    return released(shown.where("gone"), shown.where("not gone").select("doc_id", "to").union(elsewhere), ["doc_id"])


PATCHED = "doc_id bigint, content binary, warnings array<struct<code:string,detail:string>>"


def patched(found: DataFrame, edited: DataFrame) -> DataFrame:
    """doc_id, content, warnings: files with edited pages and forms as incremental updates.

    found: doc_id, content (the files); edited: the edited pages (doc_id, page_index, content, fonts and, if there,
    forms), only those that were edited. Pages and forms that are as they were aren't written; a file without edits keeps
    its bytes. Content streams that nothing else uses are released. Warnings: page-write, xobject-write, parse, encrypted.
    A file and its edited pages must fit one task.
    """
    more = [F.col("forms")] if "forms" in edited.columns else []
    listed = edited.groupBy("doc_id").agg(F.collect_list(F.struct("page_index", "content", "fonts", *more)).alias("pages"))
    gone = unused_contents(found.join(edited.select("doc_id").distinct(), "doc_id", "left_semi"), edited).groupBy("doc_id").agg(F.collect_set("to").alias("released"))
    rows = _dealt(found.select("doc_id", "content")).join(listed, "doc_id", "left").join(gone, "doc_id", "left")

    def one(content: bytes | None, edits: list[dict] | None, unused: list[int] | None) -> tuple[bytes | None, list[dict]]:
        if not edits:
            return content, []
        forms = {f["key"]: f["content"] for e in edits for _, f in e.get("forms") or [] if f["key"]}
        try:
            data, warnings = updated(content or b"", {e["page_index"]: (e["content"], dict(e["fonts"] or [])) for e in edits}, forms, tuple(unused or ()))
        except Refused as why:
            return content, [{"code": why.code, "detail": ""}]
        return data, [{"code": c, "detail": d} for c, d in warnings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("code", pa.string()), ("detail", pa.string())]))]
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                doc, content, edits, unused = (c.slice(k, 1).to_pylist()[0] for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc, *one(content, edits, unused)), kinds)], names=["doc_id", "content", "warnings"])

    return rows.mapInArrow(run, PATCHED)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """A path or URI of any store that Arrow knows."""
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Put(WriterCommitMessage):
    attempt: str
    files: int


class FilesSink(DataSource):
    """Format qf_files, option path: rows (name, content) become files of those names in one new folder of ``path``."""

    @classmethod
    def name(cls) -> str:
        return "qf_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> "FilesWriter":
        return FilesWriter(self.options["path"], self.options["run"])


class FilesWriter(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own below a hidden one. The driver's commit drops attempts that
    don't count, joins the others and renames the hidden folder, so a reader sees all files or none."""

    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def _hidden(self) -> tuple[pafs.FileSystem, str, str]:
        store, base = _store(self.path)
        return store, f"{base}/_{self.run}", f"{base}/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Put:
        from pyspark import TaskContext

        store, hidden, _ = self._hidden()
        attempt, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        store.create_dir(f"{hidden}/{attempt}", recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with store.open_output_stream(f"{hidden}/{attempt}/{name}", compression=None) as out:
                    out.write(content or b"")
                n += 1
        return Put(attempt, n)

    def commit(self, messages: list[Put | None]) -> None:
        store, hidden, shown = self._hidden()
        store.create_dir(hidden, recursive=True)
        good = {m.attempt for m in messages if m is not None and m.files}
        for info in store.get_file_info(pafs.FileSelector(hidden)):
            if info.base_name not in good:
                store.delete_dir(info.path)
        store.move(hidden, shown)

    def abort(self, messages: list[Put | None]) -> None:
        store, hidden, _ = self._hidden()
        with suppress(FileNotFoundError):
            store.delete_dir(hidden)


def save(found: DataFrame, folder: str) -> str:
    """Writes each document as <doc_id>-edited.pdf, and returns the new folder below ``folder`` that holds them.

    All files are there when the call returns, and none if it fails. What attempts that don't count have written is
    dropped; a job that fails while other tasks still write may leave some of it in the hidden folder.
    """
    found.sparkSession.dataSource.register(FilesSink)
    run = f"run-{uuid.uuid4().hex}"
    rows = found.select(F.concat(F.col("doc_id").cast("string"), F.lit("-edited.pdf")).alias("name"), "content")
    rows.write.format("qf_files").option("path", folder).option("run", run).mode("append").save()
    return f"{folder}/{run}"
