"""Story pages: item extraction with page-level checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.text import materialize, null_if_empty
from feedloom.sources.html import story_facts


def item_key(filename: Column, viewer_id: Column, media_url: Column) -> Column:
    """Stable key: file name, else id, else address; first 32 digits of its digest."""
    stable = F.coalesce(null_if_empty(filename), null_if_empty(viewer_id), media_url)
    return F.substring(F.sha2(stable, 256), 1, 32)


def story_items(pages: DataFrame, username: str) -> DataFrame:
    """One row per distinct item and page; a page that fails a check has one row with ``failure``.

    ``pages`` carries page_id and html. Items are de-duplicated inside the row of their page.
    """
    flagged = pages.select("page_id", _challenged(F.lower("html")).alias("challenged"), "html")
    facts = story_facts(flagged)
    usable = F.filter(
        F.transform(
            "elements",
            lambda e, i: F.struct(
                i.cast("bigint").alias("position"),
                F.trim(e["viewer_id"]).alias("viewer_id"),
                F.trim(e["media_url"]).alias("media_url"),
                F.lower(F.trim(e["media_type"])).alias("media_type"),
                F.regexp_extract(F.trim(e["filename"]), "([^/]+)/*$", 1).alias("filename"),
                F.trim(e["slide"]).try_cast("int").alias("slide"),
            ),
        ),
        lambda e: (e["viewer_id"] != "") & e["media_url"].rlike("^https?://"),
    )
    keyed = F.transform(
        usable,
        lambda e: e.withField("key", item_key(e["filename"], e["viewer_id"], e["media_url"])).withField(
            "media_type", F.when(e["media_type"].isin("image", "video"), e["media_type"]).otherwise("unknown")
        ),
    )
    listed = materialize(facts, items=keyed)
    counted = materialize(
        listed,
        known=F.lower(F.concat_ws(" ", "page_title", "profile_text")).contains(username.lower()),
        distinct_items=F.size(F.array_distinct(F.transform("items", lambda e: e["key"]))),
        advertised=F.coalesce(F.trim("counter_text").try_cast("int"), F.lit(0)),
    )
    failure = (
        F.when(~F.col("known") & F.col("challenged"), "challenge page")
        .when(~F.col("known"), "unexpected profile")
        .when(
            F.col("advertised") > F.col("distinct_items"),
            F.format_string("advertised %d items but exposed only %d", "advertised", "distinct_items"),
        )
    )
    judged = materialize(counted, failure=failure)
    rows = judged.select(
        "page_id", "failure", F.explode_outer(F.when(F.col("failure").isNull(), F.col("items"))).alias("item")
    )
    first = rows.groupBy("page_id", F.col("item.key").alias("key")).agg(
        F.first("failure").alias("failure"), F.min_by("item", "item.position").alias("item")
    )
    return first.select(
        "page_id",
        "failure",
        "key",
        "item.position",
        "item.viewer_id",
        "item.media_type",
        "item.media_url",
        "item.filename",
        "item.slide",
    )


def _challenged(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in rules.CHALLENGE_WORDS])


def failed_pages(items: DataFrame) -> DataFrame:
    return items.filter("failure is not null").select("page_id", "failure")
