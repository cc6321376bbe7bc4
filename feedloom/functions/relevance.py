"""Relevance columns: cohort, role and location rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.text import any_word, bind, fold_hint, matches, word_array


def cohort_allowed(text: Column, filters: rules.Filters) -> Column:
    """No graduation year in the text, or the target year among them."""

    def years(bare: Column) -> Column:
        return ~matches(bare, r"\b20\d{2}\b") | matches(bare, rf"\b{filters.target_year}\b")

    return bind(F.translate(F.lower(text), "-_", "  "), years)


def role_rejection(
    title: Column, description: Column, filters: rules.Filters, source_context: Column | None = None
) -> Column:
    """Name of the first rule that rejects a role, or null when it is relevant.

    ``source_context`` lets a sparse row inherit early-career evidence from its feed.
    """
    title = F.coalesce(title, F.lit(""))
    description = F.coalesce(description, F.lit(""))
    context = fold_hint(F.coalesce(source_context, F.lit(""))) if source_context is not None else F.lit("")
    inputs = F.struct(
        title.alias("title"),
        F.lower(title).alias("low"),
        F.lower(F.concat(title, F.lit(" "), description)).alias("all"),
        context.alias("context"),
    )

    def reason(row: Column) -> Column:
        low, everything = row["low"], row["all"]
        mentions_years = any_word(everything, rules.YEARS_GUARD)
        early = (
            any_word(low, rules.ENTRY_TITLE_WORDS)
            | any_word(row["context"], rules.EARLY_CAREER_WORDS)
            | any_word(everything, rules.EARLY_CAREER_WORDS)
            # The pattern's other branch consists of early-career words, tested above.
            | (mentions_years & matches(everything, rules.ENTRY_TEXT_PATTERN))
        )
        return (
            F.when(any_word(low, rules.SUPPORT_TITLE_WORDS), "support_title")
            .when(~cohort_allowed(row["title"], filters), "cohort")
            .when(any_word(low, rules.SENIOR_WORDS), "senior_title")
            .when(matches(low, rules.MID_LEVEL_TITLE_PATTERN), "mid_level_title")
            .when(matches(low, rules.NON_ENTRY_TITLE_PATTERN, ignore_case=True), "non_entry_title")
            .when(~any_word(low, rules.ROLE_WORDS), "no_role_in_title")
            # Tests of the long text come last: most rows are gone before they run.
            .when(any_word(everything, rules.EXCLUDED_WORDS), "excluded_word")
            .when(any_word(everything, [f.lower() for f in filters.excluded_families]), "excluded_family")
            .when(mentions_years & matches(everything, rules.EXPERIENCE_PATTERN), "experience")
            .when(~early, "no_early_career_signal")
        )

    return bind(inputs, reason)


def is_relevant_role(
    title: Column, description: Column, filters: rules.Filters, source_context: Column | None = None
) -> Column:
    return role_rejection(title, description, filters, source_context).isNull()


def sparse_context(description: Column, feed: Column, url: Column) -> Column:
    """Feed name and address as evidence, only for rows without a description."""
    return F.when(F.coalesce(description, F.lit("")) == "", F.concat_ws(" ", feed, url)).otherwise(F.lit(""))


def us_signal(location: Column) -> Column:
    """Country words, state names, metro shorthands or a ``, XX`` state code."""
    code = F.regexp_extract(location, rules.US_STATE_CODE_PATTERN, 1)

    def words(low: Column) -> Column:
        shorthand = F.array_contains(word_array(rules.US_METRO_SHORTHANDS), low)
        return any_word(low, (*rules.US_WORDS, *rules.US_STATE_NAMES)) | shorthand

    return bind(fold_hint(location), words) | F.array_contains(word_array(rules.US_STATE_CODES), code)


def non_us_signal(location: Column) -> Column:
    return bind(F.lower(location), lambda low: any_word(low, rules.NON_US_PLACES))


def location_allowed(location: Column, filters: rules.Filters) -> Column:
    """Ordered location rule; a missing place passes."""
    allowed = [place.lower() for place in filters.allowed_locations]
    excluded = [place.lower() for place in filters.excluded_locations]

    def rule(row: Column) -> Column:
        low, in_us = row["low"], row["us"]
        us_wanted = F.lit("united states" in allowed)
        return (
            F.when(any_word(low, excluded), False)
            .when(any_word(low, rules.NON_US_PLACES) & ~in_us, False)
            .when(low.contains("remote"), True)
            .when(us_wanted & (in_us | (F.trim(low) == "us")), True)
            .otherwise(any_word(low, allowed))
        )

    inputs = F.struct(F.lower(location).alias("low"), us_signal(location).alias("us"))
    return F.when(F.coalesce(F.length(location), F.lit(0)) == 0, True).otherwise(bind(inputs, rule))
