"""Session-level helpers: shared scratch storage, partition counts and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 100_000
SALTS = 32
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set, in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives the files of its shuffles back when it is done.

    Otherwise they stay until the driver collects its garbage, and a loop of many small steps fills the disk with them.
    """
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what several branches read is computed once."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy per-row work at least one partition per core.

    Files are cut by size, so a small or single-block table would keep one core busy. A table with
    enough partitions, which is the normal case, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the table was found to hold at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    salt_by: str | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows with a table that is unique on ``on``.

    A lookup of checked size is broadcast. A larger one is copied once per salt, and the rows are
    spread over the salts by ``salt_by``, so that one key with a third of all rows is split.
    """
    if fits_broadcast(lookup, max_rows):
        return rows.join(F.broadcast(lookup), on, how)
    if salt_by is None:
        return rows.join(lookup, on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def skew_join(
    rows: DataFrame, other: DataFrame, on: list[str], salt_by: str, how: str = "inner", per_salt: int = 10_000
) -> DataFrame:
    """Join two tables of which ``rows`` may hold a large part of its rows under one key.

    Keys with more than ``per_salt`` rows are counted first; such a key is dealt to as many salts as it
    needs, and only its rows of ``other`` are copied, once per salt. All other keys have one salt.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_salt)
    hot = land(counts.select(*on, F.ceil(F.col("_n") / per_salt).cast("int").alias("_salts")), "hot-keys")

    def marked(df: DataFrame) -> DataFrame:
        # Unique by key. Beyond the size for a broadcast Spark shuffles by the key; no key has few salts and many rows.
        side = F.broadcast(hot) if fits_broadcast(hot) else hot
        return df.join(side, on, "left")

    dealt = F.pmod(F.xxhash64(salt_by), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = marked(rows).withColumn("_salt", dealt).drop("_salts")
    copied = marked(other).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")
