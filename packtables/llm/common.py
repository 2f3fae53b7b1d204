"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packtables.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The files stay until the folder is cleaned, because the returned frame is lazy.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table with a number for each row, which stays the same when the table is read again."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """The texts of a batch, one Python string at a time."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py()


def slices(batch: pa.RecordBatch, chars: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of at most about ``chars`` characters (one long text may be more), with their texts (null: empty)."""
    texts, size, begin = [], 0, 0
    values = batch.column(batch.schema.get_field_index(column))
    for i, x in enumerate(values):
        t = x.as_py() or ""
        if texts and size + len(t) > chars:
            yield batch.slice(begin, i - begin), texts
            texts, size, begin = [], 0, i
        texts.append(t)
        size += len(t)
    if texts:
        yield batch.slice(begin), texts


def trimmed(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system at the end of its partition.

    Python workers are reused: without this, one that ran a stage with large buffers keeps them while other stages run
    beside it in workers of their own.
    """
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return wrapped


def sample_threshold(wanted: int, total: int) -> int:
    """The 63-bit number that a hash must stay below for about ``wanted`` of ``total`` rows; exact for any total."""
    return 2 ** 63 - 1 if wanted >= total else (wanted << 63) // total


def sample_hash(*columns: Column) -> Column:
    """63 bits of the columns' hash, to compare with ``sample_threshold`` (``<=``: the largest threshold takes all rows)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def free_name(df: DataFrame, base: str) -> str:
    """``base`` with underscores in front until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
