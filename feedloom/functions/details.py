"""Facts in a description: pay, work mode, sponsorship, citizenship, clearance, years, deadline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.text import UNICODE_NOCASE, any_word, bind, collapse, null_if_empty, strip, word_array


def job_details(title: Column, description: Column, location: Column, remote: Column) -> Column:
    """Typed struct of the facts; texts that are absent stay null or ``Not specified``."""
    text = collapse(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, description, location)]))
    unspecified = F.lit(rules.UNSPECIFIED)

    def facts(row: Column) -> Column:
        text, low = row["text"], row["low"]

        # A pattern runs only on texts that hold a word without which it cannot match.
        def found(guard: tuple[str, ...], pattern: str, group: int) -> Column:
            value = null_if_empty(strip(F.regexp_extract(text, UNICODE_NOCASE + pattern, group)))
            return F.when(any_word(low, guard), value)

        years = F.when(
            any_word(low, rules.GRADUATION_GUARD),
            F.regexp_extract_all(text, F.lit(UNICODE_NOCASE + rules.GRADUATION_PATTERN), F.lit(1)),
        ).otherwise(word_array(()))
        return F.struct(
            found(rules.SALARY_GUARD, rules.SALARY_PATTERN, 0).alias("salary"),
            F.when(row["remote"] | any_word(low, rules.REMOTE_TEXT_WORDS), "Remote")
            .when(any_word(low, rules.HYBRID_WORDS), "Hybrid")
            .when(any_word(low, rules.ONSITE_WORDS), "On-site")
            .otherwise(unspecified)
            .alias("work_mode"),
            F.when(~any_word(low, rules.MENTIONS_SPONSOR_WORDS), unspecified)
            .when(any_word(low, rules.NO_SPONSOR_WORDS), "Not offered")
            .when(any_word(low, rules.SPONSOR_WORDS), "Available")
            .otherwise("Check posting")
            .alias("sponsorship"),
            F.when(any_word(low, rules.CITIZEN_WORDS), "U.S. citizenship required")
            .when(any_word(low, rules.US_PERSON_WORDS), "U.S. person requirement")
            .otherwise(unspecified)
            .alias("citizenship"),
            F.when(~any_word(low, rules.MENTIONS_CLEARANCE_WORDS), unspecified)
            .when(any_word(low, rules.ACTIVE_CLEARANCE_WORDS), "Active clearance required")
            .when(any_word(low, rules.ELIGIBLE_CLEARANCE_WORDS), "Must be eligible for clearance")
            .otherwise("Check posting")
            .alias("clearance"),
            F.array_sort(F.array_distinct(years)).alias("graduation_years"),
            found(rules.DEADLINE_GUARD, rules.DEADLINE_PATTERN, 1).alias("application_deadline"),
        )

    def inputs(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lower(text).alias("low"), remote.alias("remote"))

    # Two steps, so that the collapsed text is made once for both of its readings.
    return bind(bind(text, inputs), facts)


def detail_items(details: Column) -> Column:
    """``label: value`` texts of the known facts, graduation last."""
    labels = (
        ("Work mode", "work_mode"),
        ("Salary", "salary"),
        ("Sponsorship", "sponsorship"),
        ("Citizenship", "citizenship"),
        ("Clearance", "clearance"),
        ("Deadline", "application_deadline"),
    )
    items = [
        F.when(details[key] != rules.UNSPECIFIED, F.concat(F.lit(label + ": "), details[key]))
        for label, key in labels
    ]
    years = details["graduation_years"]
    items.append(F.when(F.size(years) > 0, F.concat(F.lit("Graduation: "), F.array_join(years, ", "))))
    return F.array_compact(F.array(*items))
