"""Duplicates within a batch: one shuffle on the canonical key, combined before it.

Two listings are the same when their primary identities are equal, so the classes are plain groups
and need no graph search. All aggregates merge, so a key with a third of all rows leaves every
task as a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_FIELDS = ("description_text", "description_hash", "content_hash")


def merge_duplicates(normalized: DataFrame, key: str = "canonical_key") -> DataFrame:
    """First row per key with the longest text, the highest confidence and all source names.

    Adds ``duplicates`` (rows merged away), ``seen_in_sources`` (null without a duplicate) and, if
    the rows carry ``raw_job_id``, the id of the last row.
    """
    order = F.struct("source_ordinal", "position")
    # The earliest of the longest texts wins: only a strictly longer one replaces the first.
    preference = F.struct(F.length("description_text"), -F.col("source_ordinal"), -F.col("position"))
    last_raw = "raw_job_id" in normalized.columns
    merged = {key, "confidence", "raw_job_id", *TEXT_FIELDS}
    plain = [c for c in normalized.columns if c not in merged]
    aggregates = [
        F.min_by(F.struct(*plain), order).alias("first"),
        F.max_by(F.struct(*TEXT_FIELDS), preference).alias("longest"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("source_name")).alias("sources"),
        F.count(F.lit(1)).alias("rows"),
    ]
    if last_raw:
        aggregates.append(F.max_by("raw_job_id", order).alias("raw_job_id"))
    grouped = normalized.groupBy(key).agg(*aggregates)
    return grouped.select(
        key,
        "first.*",
        "longest.*",
        "confidence",
        *(["raw_job_id"] if last_raw else []),
        F.when(F.col("rows") > 1, F.col("sources")).alias("seen_in_sources"),
        (F.col("rows") - 1).alias("duplicates"),
    )


def duplicate_count(normalized: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Rows merged away in total, without moving any text."""
    per_key = normalized.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return per_key.agg(
        F.sum("rows").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.sum(F.col("rows") - 1).alias("duplicates"),
    )


def source_counts(collected: DataFrame) -> DataFrame:
    return collected.groupBy("source_name").agg(F.count(F.lit(1)).alias("listings"))


def last_raw_ids(rows: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Id of the last landed row per key."""
    return rows.groupBy(key).agg(
        F.max_by("raw_job_id", F.struct("source_ordinal", "position")).alias("raw_job_id")
    )
