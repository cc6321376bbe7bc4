"""Collected rows to normalized rows: identity, hashes, place, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.details import job_details
from feedloom.functions.text import is_remote, materialize, normalized_location, strip, title_slug
from feedloom.functions.urls import identity_of


def raw_job_id(run_id: Column | str) -> Column:
    """Id of a landed row that stays the same when a run is repeated."""
    return F.concat_ws("-", F.lit(run_id), F.col("source_ordinal"), F.col("position"))


def description_hash(description: Column, title: Column) -> Column:
    return F.sha2(F.when(description != "", description).otherwise(title), 256)


def content_hash(company: Column, title: Column, location: Column, description: Column, url: Column) -> Column:
    """Fingerprint of everything a reader sees."""
    parts = [F.coalesce(c, F.lit("")) for c in (company, title, location, description, url)]
    return F.sha2(F.concat_ws("::", *parts), 256)


def normalize(collected: DataFrame) -> DataFrame:
    """Normalized listings; map-only."""
    bare = collected.withColumn("description_text", strip(F.coalesce("description_text", F.lit(""))))
    place = materialize(
        bare,
        identity=identity_of(F.col("apply_url")),
        location_normalized=normalized_location(F.col("location_text")),
        is_remote=is_remote(F.col("location_text")),
    )
    seen = [F.col(c) for c in ("company_name", "title", "location_text", "description_text", "apply_url")]
    facts = job_details(F.col("title"), F.col("description_text"), F.col("location_normalized"), F.col("is_remote"))
    kept = [c for c in collected.columns if c not in ("company_name", "title")]
    return place.select(
        *kept,
        strip(F.col("company_name")).alias("company_name"),
        strip(F.col("title")).alias("title"),
        title_slug(F.col("title")).alias("title_normalized"),
        "location_normalized",
        "is_remote",
        F.col("identity.normalized_url").alias("normalized_url"),
        F.col("identity.primary_identity").alias("primary_identity"),
        F.sha2("identity.primary_identity", 256).alias("canonical_key"),
        description_hash(F.col("description_text"), F.col("title")).alias("description_hash"),
        content_hash(*seen).alias("content_hash"),
        facts.alias("job_details"),
    )
