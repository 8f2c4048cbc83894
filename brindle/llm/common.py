"""What the operators of this subpackage share: reading tables, staging in the shared folder, word splitting."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brindle.sources.files import spread
from brindle.sources.shared import BATCH_BYTES, ROWS, small_batches  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader whatever the store; a small file of texts is dealt to all cores."""
    small_batches(spark)
    _workers_find_package(spark)
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan


def _workers_find_package(spark: SparkSession) -> None:
    """Python workers of a local session import this package from where the driver found it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a temporary folder is made if all runs on this machine; else executors
    would not see each other's files, which is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@cache
def _own_dir() -> str:
    return Path(tempfile.mkdtemp(prefix="brindle-")).as_uri()


class _Scratch(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_scratch = _Scratch()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged within are deleted at the end, but those staged to be kept.

    Those belong to the scratch around this one, if there is one.
    """
    _scratch.open.append([])
    try:
        yield
    finally:
        for path in _scratch.open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}-{name}"
    level = len(_scratch.open) - 1 - keep
    if level >= 0:
        _scratch.open[level].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """What is executed within sends at most `rows` rows in a batch to Python: for rows that may be large."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def byte_chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of at most `most` bytes; a longer text is one of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
        yield at, stop - at
        at = stop


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `most` bytes of a text column; a longer text is one of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for at, rows in byte_chunks(b.column(column), most):
            part = b.slice(at, rows)
            more = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + more > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# One byte to one byte: A-Z to a-z, bytes of words as they are, all else to a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
CHUNK = 1 << 22


def word_chunks(text: str | None, chunk: int = CHUNK):
    """Lists of the words of a text, in order: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

    Long texts come in several lists, cut at a blank, so that memory stays bounded.
    """
    if not text:
        return
    data = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    if len(data) <= chunk:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = data.find(b" ", min(at + chunk, len(data)))
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
