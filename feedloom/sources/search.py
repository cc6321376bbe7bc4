"""Search results: results as listings, and the pages behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom import rules
from feedloom.functions.relevance import is_relevant_role, location_allowed
from feedloom.functions.text import materialize, strip
from feedloom.functions.urls import company_from_url, on_domain
from feedloom.runtime import skew_join
from feedloom.schemas import select_collected
from feedloom.sources.pages import page_listings, split_title


def results_from_payloads(payloads: DataFrame) -> DataFrame:
    """Rows of landed result files: ``{"queries": {query: [result, ...]}}``."""
    result = "struct<title: string, url: string, snippet: string, source_name: string, published_at: timestamp>"
    parsed = payloads.select(
        "source_ordinal", F.from_json("body", f"struct<queries: map<string, array<{result}>>>").alias("p")
    )
    per_query = parsed.select("source_ordinal", F.posexplode("p.queries").alias("number", "query", "results"))
    rows = per_query.select("source_ordinal", "number", "query", F.posexplode("results").alias("place", "r"))
    # Places of a payload go through its queries, so that no two results share one.
    position = F.shiftleft(F.col("number").cast("bigint"), 32) + F.col("place")
    return rows.select("source_ordinal", "query", position.alias("position"), "r.*")


def top_results(results: DataFrame, limit: int) -> DataFrame:
    """First results of every query; Spark keeps at most ``limit`` per task before the shuffle."""
    order = Window.partitionBy("query").orderBy("source_ordinal", "position")
    return results.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("place")


def direct_listings(results: DataFrame, filters: rules.Filters) -> DataFrame:
    """Results that are listings themselves, company taken from the board address."""
    split = materialize(
        results,
        split=split_title(F.col("title")),
        description_text=strip(F.coalesce(F.col("snippet"), F.lit(""))),
    )
    place = F.col("split.location")
    gate = is_relevant_role(F.col("split.title"), F.col("description_text"), filters) & (
        F.when(F.coalesce(place, F.lit("")) == "", True).otherwise(location_allowed(place, filters))
    )
    once = materialize(split, passes=gate, company_name=company_from_url(F.col("url")))
    return select_collected(
        once.filter(F.col("passes") & (F.coalesce(F.col("company_name"), F.lit("")) != "")).drop("title"),
        source_name=F.concat(F.lit("search:"), F.col("source_name")),
        source_type=F.lit("web_search"),
        source_url=F.col("url"),
        apply_url=F.col("url"),
        title=F.col("split.title"),
        location_text=place,
        posted_at=F.col("published_at"),
        search_query=F.col("query"),
        confidence=F.lit(0.55),
        metadata=F.create_map(F.lit("parser"), F.lit("search_result_direct")),
    )


def needed_pages(
    results: DataFrame, pages: DataFrame, aggregators: tuple[str, ...] = rules.SEARCH_AGGREGATORS
) -> DataFrame:
    """The landed pages, or their facts, behind results that are not on an aggregator.

    One page may stand behind many results: the distinct addresses pick the pages, so a popular page is
    read once, and no other page is parsed.
    """
    wanted = results.filter(~on_domain(F.col("url"), aggregators)).select("url").distinct()
    return pages.join(wanted, "url", "left_semi")


def page_results(results: DataFrame, facts: DataFrame, filters: rules.Filters, per_salt: int = 10_000) -> DataFrame:
    """Listings found on the pages behind results, stamped with the query.

    One address may be a third of all results, and one page may hold many listings: ``skew_join`` deals out the
    results of an address, and copies the listings of that page only.
    """
    pages = needed_pages(results, facts).select(
        "page_id",
        "url",
        "page_title",
        "postings",
        "anchors",
        F.lit(None).cast("string").alias("company_name"),
        F.lit("web_search").alias("source_type"),
    )
    found = page_listings(pages, filters, F.lit(True)).drop("source_name", "source_ordinal", "search_query")
    keyed = results.filter(~on_domain(F.col("url"), rules.SEARCH_AGGREGATORS)).select(
        F.col("url").alias("source_url"),
        "source_ordinal",
        F.col("position").alias("result_position"),
        F.concat(F.lit("search:"), F.col("source_name")).alias("source_name"),
        F.col("query").alias("search_query"),
    )
    joined = skew_join(keyed, found.withColumnRenamed("position", "page_position"), ["source_url"], "result_position", per_salt=per_salt)
    # The order of a landed listing: the result, then the place on its page.
    return joined.withColumn("position", F.col("result_position"))


def search_listings(
    results: DataFrame, facts: DataFrame, filters: rules.Filters, limit: int | None = None, per_salt: int = 10_000
) -> DataFrame:
    """Direct listings and page listings of the results; of the first ``limit`` of every query where one is given.

    A result's direct listing comes before those of its page, in the order of the page.
    """
    top = results if limit is None else top_results(results, limit)
    direct = direct_listings(top, filters)
    first = direct.withColumn("position", F.shiftleft("position", 16))
    behind = page_results(top, facts, filters, per_salt)
    order = F.shiftleft(F.col("result_position"), 16) + F.col("page_position") + 1
    return first.unionByName(select_collected(behind.withColumn("position", order)))
