"""Merge of a batch into the listing state: match, lifecycle, history, user decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.times import as_timestamp
from feedloom.functions.urls import canonical_key
from feedloom.runtime import lookup_join

# Columns of a stored listing that every sighting overwrites.
OVERWRITTEN = (
    "raw_job_id",
    "source_name",
    "source_type",
    "source_url",
    "apply_url",
    "company_name",
    "title",
    "title_normalized",
    "external_job_id",
    "job_family",
    "location_text",
    "location_normalized",
    "is_remote",
    "posted_at",
    "description_text",
    "description_hash",
    "content_hash",
    "confidence",
    "job_details",
)


def alias_index(state: DataFrame) -> DataFrame:
    """``canonical_key`` of today's identity to ``alias_key`` of the stored row it means.

    Only rows stored under another key than the one their address gives today can be found by
    alias: any other row is an exact hit. That leaves the few legacy rows, picked by a map-side
    filter; the oldest stored row wins, and an exact row beats all of them.
    """
    today = state.select(
        F.col("canonical_key").alias("alias_key"),
        canonical_key(F.col("apply_url")).alias("canonical_key"),
        F.struct("first_seen_at", "job_id").alias("age"),
    )
    legacy = today.filter(F.col("alias_key") != F.col("canonical_key"))
    oldest = legacy.groupBy("canonical_key").agg(F.min_by("alias_key", "age").alias("alias_key"))
    return oldest.join(state.select("canonical_key"), "canonical_key", "left_anti")


def match_state(batch: DataFrame, state: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Add ``state_key``: the key under which a listing is, or will be, stored.

    With ``index``, the maintained alias index, nothing is computed over the stored rows.
    """
    return batch.join(alias_index(state) if index is None else index, "canonical_key", "left").select(
        *batch.columns, F.coalesce("alias_key", "canonical_key").alias("state_key")
    )


def new_candidates(matched: DataFrame, state: DataFrame) -> DataFrame:
    """Listings without a stored row."""
    keys = state.select(F.col("canonical_key").alias("state_key"))
    return matched.join(keys, "state_key", "left_anti")


def with_company_id(batch: DataFrame, companies: DataFrame) -> DataFrame:
    """Company id by name, case ignored; names are unique, so no row is multiplied."""
    names = companies.groupBy(F.lower("name").alias("_name")).agg(F.min("company_id").alias("company_id"))
    keyed = batch.withColumn("_name", F.lower("company_name"))
    return lookup_join(keyed, names, ["_name"], salt_by="canonical_key").drop("_name")


def lifecycle(
    status: Column, last_seen: Column, stored_hash: Column, new_hash: Column, as_of: Column | str, stale_days: int
) -> Column:
    """new without a stored row; reopened if unmanaged, unseen for long enough and changed; else seen."""
    unseen = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(last_seen)
    reopened = (
        ~status.isin(*rules.USER_STATES) & (unseen >= stale_days * 86_400_000_000) & (stored_hash != new_hash)
    )
    return F.when(status.isNull(), rules.NEW).when(reopened, rules.REOPENED).otherwise(rules.SEEN)


def merge_state(
    matched: DataFrame,
    state: DataFrame,
    as_of: str,
    stale_days: int = rules.Limits.reopen_after_days,
    partitions: int | None = None,
) -> DataFrame:
    """The whole next state, with ``lifecycle_state`` (null for rows that the batch did not touch), the landing
    order of the touched rows and ``today_key``, the key that their address gives.

    Given the stored rows of the batch's keys instead of all, the result is what the batch changes.

    ``matched`` has state_key and company_id. Several listings may mean one legacy row: the first
    decides the lifecycle, the last one is stored. With ``partitions`` (the bucket number of the
    stored side) the batch is moved to the buckets and the stored rows stay where they are; batch
    keys are unique by then, so no partition can run hot.
    """
    if partitions:
        matched = matched.repartition(partitions, "state_key")
    order = F.struct("source_ordinal", "position")
    incoming = [c for c in (*OVERWRITTEN, "metadata", "seen_in_sources", "company_id")]
    batch = matched.groupBy("state_key").agg(
        F.max_by(F.struct(*incoming, F.col("canonical_key").alias("today_key")), order).alias("b"),
        F.min_by("content_hash", order).alias("first_hash"),
        F.min(order).alias("landed"),
    )
    stored = state.select(F.col("canonical_key").alias("state_key"), F.struct(*state.columns).alias("s"))
    joined = batch.join(stored, "state_key", "full_outer")
    now = as_timestamp(as_of)
    touched = F.col("b").isNotNull()
    life = lifecycle(
        F.col("s.current_status"), F.col("s.last_seen_at"), F.col("s.content_hash"), F.col("first_hash"), as_of, stale_days
    )
    joined = joined.withColumn("life", F.when(touched, life))
    is_new, managed = F.col("life") == rules.NEW, F.col("s.current_status").isin(*rules.USER_STATES)

    def pick(name: str) -> Column:
        return F.when(touched, F.col(f"b.{name}")).otherwise(F.col(f"s.{name}"))

    sources = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.concat(
                    F.coalesce("s.seen_in_sources", F.expr("cast(array() as array<string>)")),
                    F.coalesce("b.seen_in_sources", F.expr("cast(array() as array<string>)")),
                    F.array("s.source_name", "b.source_name"),
                )
            )
        )
    )
    overlaid = F.map_zip_with(
        F.coalesce("s.metadata", F.expr("cast(map() as map<string,string>)")),
        F.coalesce("b.metadata", F.expr("cast(map() as map<string,string>)")),
        lambda _, old, new: F.coalesce(new, old),
    )
    columns = {
        "job_id": F.coalesce("s.job_id", "state_key"),
        "canonical_key": F.col("state_key"),
        "company_id": F.coalesce("b.company_id", "s.company_id"),
        **{name: pick(name) for name in OVERWRITTEN},
        "current_status": F.when(~touched | managed, F.col("s.current_status")).otherwise(F.col("life")),
        "application_status": F.col("s.application_status"),
        "applied_at": F.col("s.applied_at"),
        "application_notes": F.col("s.application_notes"),
        "application_url": F.col("s.application_url"),
        "reopened_count": F.coalesce("s.reopened_count", F.lit(0))
        + F.when(F.col("life") == rules.REOPENED, 1).otherwise(0),
        "first_seen_at": F.coalesce("s.first_seen_at", now),
        "last_seen_at": F.when(touched, now).otherwise(F.col("s.last_seen_at")),
        "metadata": F.when(is_new, F.col("b.metadata")).when(touched, overlaid).otherwise(F.col("s.metadata")),
        "seen_in_sources": F.when(is_new, F.col("b.seen_in_sources"))
        .when(touched, sources)
        .otherwise(F.col("s.seen_in_sources")),
        "today_key": F.col("b.today_key"),
        "lifecycle_state": F.col("life"),
        "source_ordinal": F.col("landed.source_ordinal"),
        "position": F.col("landed.position"),
    }
    extra = ("today_key", "lifecycle_state", "source_ordinal", "position")
    by_name = {name: value.alias(name) for name, value in columns.items()}
    return joined.select(*[by_name[c] for c in state.columns], *[by_name[c] for c in extra])


def status_history(merged: DataFrame, as_of: str) -> DataFrame:
    """One history row per new or reopened listing."""
    return merged.filter(F.col("lifecycle_state").isin(*rules.ACTIONABLE)).select(
        "job_id",
        F.col("lifecycle_state").alias("status"),
        as_timestamp(as_of).alias("changed_at"),
        F.lit(None).cast("string").alias("notes"),
    )


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid decisions and those with a status no user can set."""
    valid = F.coalesce(F.col("status").isin(*rules.USER_STATES), F.lit(False))
    return decisions.filter(valid), decisions.filter(~valid)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Net effect of all decisions per key: last status, last notes, last time applied."""
    order = F.struct("decided_at", "decision_id")
    has_notes = F.coalesce(F.col("notes"), F.lit("")) != ""
    return decisions.groupBy("canonical_key").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("notes", F.when(has_notes, order)).alias("notes"),
        F.max(F.when(F.col("status") == rules.APPLIED, F.col("decided_at"))).alias("applied_at"),
    )


def apply_decisions(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """State after the decisions; unknown keys have no effect."""
    valid, _ = split_decisions(decisions)
    net = latest_decisions(valid).select("canonical_key", F.struct("status", "notes", "applied_at").alias("d"))
    joined = state.join(net, "canonical_key", "left")
    changed = {
        "current_status": F.coalesce("d.status", "current_status"),
        "application_status": F.coalesce("d.status", "application_status"),
        "application_notes": F.coalesce("d.notes", "application_notes"),
        "applied_at": F.coalesce("d.applied_at", "applied_at"),
        "application_url": F.when(F.col("d.applied_at").isNotNull(), F.col("apply_url")).otherwise(
            F.col("application_url")
        ),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in state.columns])


def decision_history(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """History rows of valid decisions on known keys."""
    valid, _ = split_decisions(decisions)
    keys = state.select("canonical_key", "job_id")
    return valid.join(keys, "canonical_key").select(
        "job_id", "status", F.col("decided_at").alias("changed_at"), "notes"
    )
