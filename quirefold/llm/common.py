"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_qf_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what setCheckpointDir was given.

    Where it is unset, a temporary folder is made in local mode (tests, one machine); on a cluster that is an error.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-qf-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_PASSING: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: a cut of lineage that outlives executors.

    Within ``passing`` the table is dropped at the end, unless ``keep``.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes tables that ``written`` made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside serve only results that are written with ``keep`` before the end; they are dropped then."""
    _PASSING.append([])
    try:
        yield
    finally:
        dropped(spark, *_PASSING.pop())


def whole_row(df: DataFrame, **keys: Column) -> DataFrame:
    """``keys`` beside one struct of all columns of ``df``, so that own columns never clash with the input's.

    Keys must not be named like ``_qf_row``. ``unpacked`` is the way back.
    """
    return df.select(*[c.alias(k) for k, c in keys.items()], F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def letters(text: Column) -> Column:
    """True if the text has a letter of any script."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, columns: list[int], rows: int = 2000, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and about ``size`` bytes in the given string columns, one row at least."""
    upto = np.zeros(batch.num_rows, "i8")
    for k in columns:
        upto += pc.binary_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    upto, at = np.cumsum(upto), 0
    while at < batch.num_rows:
        stop = max(at + 1, min(at + rows, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def trimmed() -> None:
    """Gives memory that a Python worker no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call, nothing is given back
        ctypes.CDLL(None).malloc_trim(0)


_HELD: dict[str, Callable[[], None]] = {}


def holding(family: str, release: Callable[[], None]) -> None:
    """Called in a Python worker before it fills a cache: caches of other families are released, so a worker that
    serves several stages holds one family at a time."""
    for other in [k for k in _HELD if k != family]:
        _HELD.pop(other)()
        trimmed()
    _HELD[family] = release
