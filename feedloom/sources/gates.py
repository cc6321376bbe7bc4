"""Gates shared by all sources: relevance, cohort and location, applied while landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.relevance import cohort_allowed, is_relevant_role, location_allowed


def listing_gate(filters: rules.Filters, source_context: Column | None = None) -> Column:
    """True for listings that may enter; reads title, description_text, apply_url, location_text."""
    title = F.coalesce(F.col("title"), F.lit(""))
    return (
        location_allowed(F.col("location_text"), filters)
        & cohort_allowed(F.concat_ws(" ", title, F.col("apply_url")), filters)
        & is_relevant_role(title, F.col("description_text"), filters, source_context)
    )


def pass_gate(df: DataFrame, filters: rules.Filters, source_context: Column | None = None) -> DataFrame:
    return df.filter(listing_gate(filters, source_context))
