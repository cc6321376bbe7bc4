"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import runtime

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    This cuts the lineage: what is read later no longer depends on executors that may be lost, nor on the shuffles
    that made it, which are dropped. The reader gets the schema, so that an empty table is read like any other.
    """
    return runtime.land(df, name)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20) -> Iterator[None]:
    """Send texts to Python in batches of so many rows and, but for the last row, bytes, for what is written inside.

    Both ends of the pipe hold a batch, and the buffers they take for it stay with the process; 10,000 texts are tens of megabytes.
    """
    names = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]
    before = {name: spark.conf.get(name) for name in names}
    held = int(before[names[0]])
    spark.conf.set(names[0], str(min(rows, held) if held > 0 else rows))
    spark.conf.set(names[1], str(size))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(run: Callable) -> Callable:
    """A task function for ``mapInArrow`` that gives its memory back when it ends.

    Python workers live on between tasks, and what they have freed stays with the process unless it is returned.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return task
