"""Lifecycle of listings over a stream of sightings.

Every micro-batch writes its own sightings per key and day; those partial rows merge into days when they
are read. So a late row joins its day however late it comes, the last day is there like any other, a replayed
batch replaces its own rows, and no streaming state grows. Both steps combine ahead of the shuffle: a key with a
third of all sightings reaches the lifecycle as one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom import rules

DAILY_DDL = "canonical_key string, day date, content_hash string, last_at timestamp, ordinal bigint"
DAY_US = 86_400_000_000


def _merged(rows: DataFrame, at: str) -> DataFrame:
    latest = F.max_by(F.struct("content_hash", F.col(at).alias("last_at"), "ordinal"), F.struct(at, "ordinal"))
    return rows.groupBy("canonical_key", "day").agg(latest.alias("l")).select("canonical_key", "day", "l.*")


def daily_sightings(sightings: DataFrame) -> DataFrame:
    """Last content per key and day of a table of sightings.

    ``sightings`` has canonical_key, content_hash, seen_at (timestamp) and ordinal.
    """
    rows = sightings.withColumns({"day": F.to_date("seen_at"), "ordinal": F.col("ordinal").cast("bigint")})
    return _merged(rows, "seen_at")


def write_daily(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the daily sightings of every micro-batch until all available input is read."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        daily_sightings(batch).write.mode("overwrite").parquet(f"{folder}/daily/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_daily(spark: SparkSession, folder: str) -> DataFrame:
    """All days, each merged from the batches that saw it."""
    rows = spark.read.schema(DAILY_DDL + ", batch bigint").parquet(f"{folder}/daily")
    return _merged(rows.drop("batch"), "last_at")


def lifecycle(daily: DataFrame, stale_days: int = rules.Limits.reopen_after_days) -> DataFrame:
    """canonical_key, seen_at, lifecycle_state and reopened_count of every day a key was seen."""
    days = Window.partitionBy("canonical_key").orderBy("day")
    before = daily.select(
        "canonical_key",
        "day",
        F.col("last_at").alias("seen_at"),
        "content_hash",
        F.lag("last_at").over(days).alias("before"),
        F.lag("content_hash").over(days).alias("old"),
    )
    gap = F.unix_micros("seen_at") - F.unix_micros("before")
    state = (
        F.when(F.col("before").isNull(), rules.NEW)
        .when((gap >= stale_days * DAY_US) & ~F.col("content_hash").eqNullSafe(F.col("old")), rules.REOPENED)
        .otherwise(rules.SEEN)
    )
    states = before.withColumn("lifecycle_state", state)
    count = F.count_if(F.col("lifecycle_state") == rules.REOPENED).over(days.rowsBetween(Window.unboundedPreceding, 0))
    return states.select("canonical_key", "seen_at", "lifecycle_state", count.cast("int").alias("reopened_count"))
