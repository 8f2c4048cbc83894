"""The folder that driver and executors share, for tables between the rounds of an iteration and for streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Hashes of tokens repeat beyond the 1 MB that a dictionary of Parquet is held to by default.
DICTIONARY_BYTES = 8 << 20


def shared_path(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir; where that is not set, below a temporary folder if all runs on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator:
    """A function that writes a table to the shared folder and reads it back; all of them are deleted at the end, or by an error."""
    paths: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        paths.append(shared_path(spark))
        df.write.option("compression", "zstd").parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            deleted(spark, path)


@contextmanager
def rounds(spark: SparkSession) -> Iterator:
    """A function that writes a table to the shared folder and reads it back, which ends its lineage; the last one stays, earlier ones are deleted at the end."""
    paths: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        paths.append(shared_path(spark))
        df.write.options(**{"compression": "zstd", "parquet.dictionary.page.size": str(DICTIONARY_BYTES)}).parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    yield write
    for path in paths[:-1]:
        deleted(spark, path)


#: Rows of texts, and bytes, in a batch to Python; a row of more bytes is one of its own.
TEXT_ROWS = 1_000
BATCH_BYTES = 16 << 20
ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most TEXT_ROWS rows and BATCH_BYTES in a batch to Python: a batch is in memory twice.

    It stays so, as what is planned here is executed later.
    """
    if not 0 < int(spark.conf.get(ROWS)) <= TEXT_ROWS:
        spark.conf.set(ROWS, str(TEXT_ROWS))
    if spark.conf.get(_BYTES) == "67108864b":  # not chosen by the user
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
