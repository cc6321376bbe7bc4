"""Watches: classification, first-seen keys, idempotency keys and result counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.details import job_details
from feedloom.functions.relevance import cohort_allowed, is_relevant_role, location_allowed
from feedloom.functions.text import matches, materialize
from feedloom.sources.html import html_to_text

EARLY_MATCH = "Early-career match"
UNCLEAR = "Eligibility unclear: review requirements"
BOARD_PREFIX = "https://jobs.ashbyhq.com/"

POSTING_DDL = (
    "id string, title string, location string, locationName string, descriptionHtml string, "
    "descriptionPlain string, publishedAt string, applyUrl string, jobUrl string, isListed boolean, "
    "isRemote boolean, employmentType string"
)


class InvalidMatch(RuntimeError):
    """A matching posting has no usable address; nothing of the batch is delivered."""


def posting_text(postings: DataFrame) -> DataFrame:
    """Add ``description``: markup removed, batch by batch."""
    html = F.coalesce(F.nullif("descriptionHtml", F.lit("")), "descriptionPlain", F.lit(""))
    return postings.withColumn("description", html_to_text(html))


def posting_label(filters: rules.Filters) -> Column:
    """``Early-career match``, ``Eligibility unclear ...`` or null; reads posting fields and description."""
    title = F.coalesce("title", F.lit(""))
    place = F.coalesce(F.nullif("locationName", F.lit("")), "location", F.lit(""))
    details = job_details(title, F.col("description"), place, F.coalesce("isRemote", F.lit(False)))
    years = details["graduation_years"]
    wrong_year = (F.size(years) > 0) & ~F.array_contains(years, str(filters.target_year))
    dropped = (
        ~F.coalesce("isListed", F.lit(True))
        | F.lower(F.coalesce("employmentType", F.lit(""))).contains("intern")
        | ~location_allowed(place, filters)
        | ~cohort_allowed(title, filters)
        | matches(title, rules.INTERN_TITLE_PATTERN, ignore_case=True)
        | wrong_year
    )
    # An assumed feed signal tells a role that lacks only the early-career evidence.
    return (
        F.when(dropped, F.lit(None).cast("string"))
        .when(is_relevant_role(title, F.col("description"), filters), EARLY_MATCH)
        .when(is_relevant_role(title, F.col("description"), filters, F.lit("new grad")), UNCLEAR)
    )


def classify_postings(postings: DataFrame, filters: rules.Filters) -> DataFrame:
    """Postings with ``label``, ``url`` and ``key``; unlabelled ones stay in, for the counts."""
    url = F.coalesce(F.nullif("applyUrl", F.lit("")), "jobUrl", F.lit(""))
    labelled = materialize(posting_text(postings), label=posting_label(filters), url=url)
    key = F.coalesce(F.nullif("id", F.lit("")), F.regexp_replace("url", "/application$", ""))
    return labelled.withColumn("key", key)


def invalid_matches(classified: DataFrame, prefix: str = BOARD_PREFIX) -> DataFrame:
    return classified.filter(F.col("label").isNotNull() & ~F.col("url").startswith(prefix))


def unseen(items: DataFrame, seen: DataFrame, few_items: bool = False) -> DataFrame:
    """Items whose key was never seen in their scope.

    ``seen`` only grows, a batch stays small: with ``few_items`` (the caller counted the batch) the
    batch keys are broadcast and ``seen`` is filtered where it lies; otherwise both sides meet on
    (scope, key), which spreads a hot scope over its keys.
    """
    on = ["scope", "key"]
    known = seen.select(*on)
    if few_items:
        known = known.join(F.broadcast(items.select(*on).distinct()), on, "left_semi")
    return items.join(known, on, "left_anti")


def item_key(scope: Column, key: Column) -> Column:
    """Delivery key of one item."""
    return F.sha2(F.concat_ws("|", scope, key), 256)


def batch_keys(items: DataFrame, batch: str) -> DataFrame:
    """Delivery key per batch, the same for every order, retry and size.

    The key is the digest of the number of distinct item keys and of sums over their digests: sums merge
    ahead of the shuffle, so no batch is gathered anywhere.
    """
    digest = F.sha2("key", 256)

    def part(start: int) -> Column:
        # 15 hex digits fit a bigint; the sum is a decimal, so it cannot overflow.
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)"))

    sums = items.select(batch, "key").distinct().groupBy(batch).agg(
        F.count(F.lit(1)).alias("items"), part(1).alias("a"), part(16).alias("b"), part(31).alias("c")
    )
    merged = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("items", "a", "b", "c")]), 256)
    return sums.select(batch, "items", F.substring(merged, 1, 32).alias("batch_key"))


def watch_counts(classified: DataFrame, delivered: DataFrame) -> DataFrame:
    """Total, matching and notified postings per scope."""
    totals = classified.groupBy("scope").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count("label").alias("matching_jobs")
    )
    sent = delivered.groupBy("scope").agg(F.count(F.lit(1)).alias("notified_jobs"))
    return totals.join(sent, "scope", "left").withColumn("notified_jobs", F.coalesce("notified_jobs", F.lit(0)))


def story_counts(items: DataFrame, fresh: DataFrame, relevant: Column) -> DataFrame:
    """Total, new and notified items per scope, with the delivery flag."""
    totals = items.groupBy("scope").agg(F.count(F.lit(1)).alias("total_items"))
    found = fresh.groupBy("scope").agg(
        F.count(F.lit(1)).alias("new_items"), F.count_if(relevant).alias("notified_items")
    )
    joined = totals.join(found, "scope", "left")
    return joined.select(
        "scope",
        "total_items",
        F.coalesce("new_items", F.lit(0)).alias("new_items"),
        F.coalesce("notified_items", F.lit(0)).alias("notified_items"),
        (F.coalesce("notified_items", F.lit(0)) > 0).alias("notification_sent"),
    )
