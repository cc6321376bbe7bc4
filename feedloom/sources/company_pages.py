"""Company pages of a run: scan list, boards found on the pages, their payloads, and the pages' own listings.

The stages hand over through written tables, as what one finds selects what the next one reads:

1. ``scanned``: the companies of the scan list with their landed page, if there is one.
2. ``wanted_boards``: the boards that the pages link to. Together they are the list of payloads to land;
   ``board_jobs`` reads no other payload. A board is judged once, however many companies link to it.
3. ``listings``: the relevant jobs of a company's boards; where they gave none, its page's own listings.
4. ``page_outcomes`` and ``board_outcomes``: one row per company, and per company and platform found.

A company has one landed page (slug is unique in both tables); a board has one payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.runtime import lookup_join, skew_join
from feedloom.schemas import select_collected
from feedloom.sources import boards, html, outcomes, pages

BOARD = ("platform", "board_key")
KIND = "company_page"


def scanned(companies: DataFrame, landed: DataFrame, settings: rules.Settings) -> DataFrame:
    """(slug, name, priority_tier, source_ordinal, url, html, fetched_at) of every company on the scan list.

    ``html`` is null where no page was landed.
    """
    wanted = pages.scan_list(companies, settings.priority_companies, settings.limits.max_company_pages)
    return wanted.select("slug", "name", "priority_tier").join(
        landed.select("slug", "source_ordinal", "url", "html", "fetched_at"), "slug", "left"
    )


def wanted_boards(found: DataFrame) -> DataFrame:
    """(slug, name, source_ordinal, platform, board_key, identifier, place): the boards that each page links to."""
    landed = found.filter(F.col("html").isNotNull())
    links = pages.discovered_boards(landed, "slug").filter(F.col("platform").isin(*boards.PLATFORMS))
    return links.join(landed.select("slug", "name", "source_ordinal"), "slug")


def board_jobs(payloads: DataFrame, wanted: DataFrame, filters: rules.Filters) -> DataFrame:
    """Judged postings of the wanted boards, without a company; no other payload is parsed."""
    keyed = payloads.withColumns({"platform": F.lower("platform"), "board_key": F.lower("identifier")})
    asked = wanted.select(*BOARD).distinct()
    picked = lookup_join(keyed, asked, list(BOARD), "left_semi")
    return boards.judged_postings(picked.withColumn("company_name", F.lit(None).cast("string")), filters)


def board_outcomes(wanted: DataFrame, judged: DataFrame) -> DataFrame:
    """(slug, source_name, status, total_available, relevant_jobs, error) per company and platform.

    Of several boards of one platform on a page the last one is reported; ``relevant_total`` adds up all.
    """
    seen = judged.groupBy(*BOARD).agg(
        F.count("position").alias("available"),
        F.count_if(F.coalesce(F.col("passes"), F.lit(False))).alias("relevant"),
        F.max("failure").alias("failure"),
    )
    joined = lookup_join(wanted, seen, list(BOARD), salt_by="slug")
    failed = F.col("available").isNull() | F.col("failure").isNotNull()
    error = F.coalesce(F.col("failure"), F.lit("no payload was landed"))
    each = F.struct(
        F.when(failed, outcomes.FAILED).otherwise(outcomes.HEALTHY).alias("status"),
        F.when(~failed, F.col("available")).alias("total_available"),
        F.when(~failed, F.col("relevant")).otherwise(F.lit(0)).cast("bigint").alias("relevant_jobs"),
        F.when(failed, error).alias("error"),
    )
    ranked = joined.withColumn("o", each).groupBy("slug", "name", "platform").agg(
        F.max_by("o", "place").alias("o"), F.sum("o.relevant_jobs").alias("relevant_total")
    )
    return ranked.select("slug", F.concat_ws(":", F.lit("discovered"), "platform", "name").alias("source_name"), "o.*", "relevant_total")


def board_listings(wanted: DataFrame, judged: DataFrame) -> DataFrame:
    """The relevant jobs of the boards, for each company that links to them."""
    passed = judged.filter("passes").drop("company_name", "identifier", "source_ordinal", "source_name")
    rows = skew_join(wanted.withColumnRenamed("source_ordinal", "page_ordinal"), passed, list(BOARD), salt_by="slug")
    placed = rows.withColumns(
        {
            "source_ordinal": F.col("page_ordinal"),
            "company_name": F.col("name"),
            "source_name": F.concat_ws(":", "platform", "name"),
            # Behind a page's own listings, board by board.
            "position": F.shiftleft(F.col("place").cast("bigint") + 1, 32) + F.col("position"),
        }
    )
    return boards.collect_boards(placed)


def own_listings(facts: DataFrame, answered: DataFrame, filters: rules.Filters) -> DataFrame:
    """Listings on the pages of companies whose boards gave no relevant job."""
    rest = facts.join(answered.select("slug"), "slug", "left_anti")
    return pages.page_listings(rest, filters, F.coalesce(F.col("priority_tier"), F.lit(3)) <= 1, "slug")


def page_facts(found: DataFrame) -> DataFrame:
    """What the landed pages say, one row per company."""
    facts = html.page_facts(found.filter(F.col("html").isNotNull()))
    return facts.withColumns(
        {
            "source_name": F.concat(F.lit("company:"), "slug"),
            "source_type": F.lit(KIND),
            "company_name": F.col("name"),
        }
    )


def page_outcomes(found: DataFrame, per_board: DataFrame, own: DataFrame) -> DataFrame:
    """One row per company of the scan list: jobs of its boards, else those of its page."""
    from_boards = per_board.groupBy("slug").agg(F.sum("relevant_total").alias("jobs"))
    from_page = own.groupBy("source_name").agg(F.count(F.lit(1)).alias("listed"))
    rows = found.select(F.concat(F.lit("company:"), "slug").alias("source_name"), "slug", F.col("html").isNotNull().alias("landed"))
    joined = rows.join(from_boards, "slug", "left").join(from_page, "source_name", "left")
    jobs = F.when(F.col("jobs") > 0, F.col("jobs")).otherwise(F.coalesce("listed", F.lit(0)))
    return joined.select(
        "source_name",
        F.when(F.col("landed"), outcomes.HEALTHY).otherwise(outcomes.FAILED).alias("status"),
        F.lit(None).cast("bigint").alias("total_available"),
        F.when(F.col("landed"), jobs).otherwise(F.lit(0)).cast("bigint").alias("relevant_jobs"),
        F.when(~F.col("landed"), "no page was landed").alias("error"),
    )


def collect(companies: DataFrame, landed: DataFrame, payloads: DataFrame, settings: rules.Settings, written) -> tuple:
    """(listings, outcomes) of all company pages. ``written(df, name)`` writes a table and reads it back."""
    found = scanned(companies, landed, settings)
    wanted = written(wanted_boards(found), "company_boards")
    judged = written(board_jobs(payloads, wanted, settings.filters), "company_board_jobs")
    per_board = written(board_outcomes(wanted, judged), "company_board_outcomes")
    facts = written(page_facts(found), "company_facts")
    own = written(own_listings(facts, per_board.filter("relevant_total > 0").distinct(), settings.filters), "company_own")
    listings = board_listings(wanted, judged).unionByName(select_collected(own))
    columns = ("source_name", "status", "total_available", "relevant_jobs", "error")
    states = page_outcomes(found, per_board, own).select(*columns).unionByName(per_board.select(*columns))
    return listings, states.withColumn("kind", F.lit(KIND))
