"""Digest and alerts: selection, sections and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom import rules
from feedloom.functions.details import detail_items
from feedloom.functions.text import readable_summary
from feedloom.functions.times import as_timestamp, days_since, short_date

# Band floors and their labels, highest first.
MATCH_BANDS = ((80, "Excellent"), (70, "Strong"), (60, "Good"))
COMPETITION_BANDS = ((70, "Very high"), (55, "High"), (40, "Moderate"))
RECOMMENDATION_TEXT = {
    rules.APPLY_NOW: "Apply soon",
    rules.APPLY_IF_INTERESTED: "Worth applying",
    rules.LOW_PRIORITY: "Optional",
    rules.SKIP: "Skip",
}
SECTIONS = ("Best matches", "Also worth a look", "Lower priority")


def _band(score: Column, bands, default: str) -> Column:
    floor, label = bands[0]
    value = F.when(score >= floor, label)
    for floor, label in bands[1:]:
        value = value.when(score >= floor, label)
    return value.otherwise(default)


def match_label(fit: Column) -> Column:
    return _band(fit, MATCH_BANDS, "Possible")


def competition_label(difficulty: Column) -> Column:
    return _band(difficulty, COMPETITION_BANDS, "Typical")


def recommendation_text(recommendation: Column) -> Column:
    value = None
    for key, text in RECOMMENDATION_TEXT.items():
        value = F.when(recommendation == key, text) if value is None else value.when(recommendation == key, text)
    return value


def is_actionable() -> Column:
    return F.col("lifecycle_state").isin(*rules.ACTIONABLE)


def alert_filter(threshold: int) -> Column:
    return (
        is_actionable()
        & (F.col("fit_score") >= threshold)
        & F.col("recommendation").isin(rules.APPLY_NOW, rules.APPLY_IF_INTERESTED)
    )


def alerts(ranked: DataFrame, thresholds: rules.Thresholds, subject_prefix: str = "[Listings]") -> DataFrame:
    """One row per immediate alert: subject and body."""
    chosen = ranked.filter(
        alert_filter(thresholds.alert_fit) & (F.col("fit_score") >= thresholds.high_signal_fit)
    )
    name = F.concat_ws(" - ", "company_name", "title")
    body = F.concat_ws(
        "\n",
        F.concat_ws(" | ", "company_name", "title"),
        F.concat(F.lit("Location: "), F.coalesce("location_text", F.lit("Unknown"))),
        F.concat(F.lit("Fit: "), F.col("fit_score").cast("string")),
        F.concat(F.lit("Difficulty: "), F.col("difficulty_score").cast("string")),
        F.concat(F.lit("Apply: "), F.col("apply_url")),
        F.lit(""),
        "fit_summary",
        "difficulty_summary",
    )
    return chosen.select(
        "canonical_key", F.concat(F.lit(subject_prefix + " Immediate alert: "), name).alias("subject"), body.alias("body")
    )


def digest_filter(thresholds: rules.Thresholds) -> Column:
    return (
        is_actionable()
        & (F.col("fit_score") >= thresholds.digest_min_fit)
        & (F.col("recommendation") != rules.SKIP)
    )


def digest_order(tie: list[str]) -> list[Column]:
    return [F.col("fit_score").desc(), F.col("difficulty_score").asc(), *[F.col(c).asc() for c in tie]]


def top_matches(ranked: DataFrame, thresholds: rules.Thresholds, tie: list[str]) -> DataFrame:
    """The digest: best fit first, lower difficulty first on a tie, then landing order."""
    return ranked.filter(digest_filter(thresholds)).orderBy(*digest_order(tie)).limit(thresholds.max_digest_jobs)


def top_matches_per(ranked: DataFrame, group: str, thresholds: rules.Thresholds, tie: list[str]) -> DataFrame:
    """The same cut for every profile or source; a window group limit keeps the shuffle small."""
    order = Window.partitionBy(group).orderBy(*digest_order(tie))
    placed = ranked.filter(digest_filter(thresholds)).withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= thresholds.max_digest_jobs)


def section(thresholds: rules.Thresholds) -> Column:
    """Section of a listing after the cut."""
    return (
        F.when(F.col("fit_score") >= thresholds.top_priority_fit, SECTIONS[0])
        .when(F.col("fit_score") >= thresholds.high_signal_fit, SECTIONS[1])
        .otherwise(SECTIONS[2])
    )


def cross_run_text(as_of: str) -> Column:
    """First seen, change of fit and reopening; empty for new listings."""
    days = days_since(F.col("first_seen_at"), as_of)
    delta = F.col("fit_score") - F.col("prev_fit_score")
    seen = F.concat(
        F.lit("first seen "), days.cast("string"), F.when(days == 1, " day ago").otherwise(" days ago")
    )
    change = F.concat(
        F.lit("prev fit "),
        F.col("prev_fit_score").cast("string"),
        F.when(delta >= 0, " (+").otherwise(" ("),
        delta.cast("string"),
        F.lit(")"),
    )
    reopened = F.when(F.col("lifecycle_state") == rules.REOPENED, "reopened")
    return F.when(F.col("lifecycle_state") == rules.NEW, F.lit("")).otherwise(
        F.concat_ws(" | ", seen, change, reopened)
    )


def listing_text(as_of: str) -> Column:
    """The block of lines that stands for one listing."""
    matching = F.array_join(F.slice("top_matching_skills", 1, 5), ", ")
    items = F.array_join(detail_items(F.col("job_details")), " | ")
    cross = cross_run_text(as_of)
    fit, hard = F.col("fit_score").cast("string"), F.col("difficulty_score").cast("string")
    place = F.coalesce(F.nullif("location_text", F.lit("")), F.lit("Location not listed"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- "), F.concat_ws(" - ", "company_name", "title")),
        F.concat(
            F.lit("  "), place, F.lit(" | Posted "), F.coalesce(short_date(F.col("posted_at")), F.lit("date not listed"))
        ),
        F.concat(F.lit("  Recommendation: "), recommendation_text(F.col("recommendation"))),
        F.concat(
            F.lit("  Match: "), match_label(F.col("fit_score")), F.lit(" ("), fit, F.lit("/100) | Competition: "),
            competition_label(F.col("difficulty_score")), F.lit(" ("), hard, F.lit("/100)"),
        ),
        F.concat(F.lit("  Why it fits: "), readable_summary(F.col("fit_summary"), "Fit")),
        F.concat(F.lit("  Keep in mind: "), readable_summary(F.col("difficulty_summary"), "Difficulty")),
        F.concat(
            F.lit("  Matching experience: "),
            F.when(matching == "", "general software engineering experience").otherwise(matching),
        ),
        F.when(items != "", F.concat(F.lit("  Details: "), items)),
        F.concat(F.lit("  Apply: "), F.col("apply_url")),
        F.when(cross != "", F.concat(F.lit("  Cross-analysis: "), cross)),
    )


def application_brief(profile: rules.Profile) -> Column:
    """Short brief per ranked listing for whoever tailors the application."""
    owned, weak = F.array_join("top_matching_skills", ", "), F.array_join("missing_or_weaker_skills", ", ")
    return F.concat(
        F.lit("Prepare an application to "),
        F.concat_ws(" - ", "company_name", "title"),
        F.lit(f". Internships to name: {'; '.join(profile.internships)}. Skills to show: "),
        F.when(owned == "", "core software skills").otherwise(owned),
        F.lit(". Skills to explain or leave out: "),
        F.when(weak == "", "none").otherwise(weak),
        F.lit(". Close with a project that reached its users."),
    )


def render_digest(
    runs: DataFrame, chosen: DataFrame, errors: DataFrame, stats: DataFrame, as_of: str, settings: rules.Settings
) -> DataFrame:
    """One row per run: subject, text and number of listings; none when empty digests are off.

    ``chosen`` is the cut (at most ``max_digest_jobs`` rows) with ``place``; only these are gathered
    into one text. ``runs`` and ``stats`` are one row each and joined on run_id, as are the errors.
    """
    thresholds = settings.thresholds
    lines = chosen.select("run_id", section(thresholds).alias("section"), "place", listing_text(as_of).alias("text"))
    gathered = lines.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.array_sort(F.collect_list(F.struct("place", "section", "text"))).alias("blocks"),
    )
    # One note per configured source and finding.
    notes = errors.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("issues"),
        F.array_sort(F.collect_list(F.concat(F.lit("- "), "source_name", F.lit(": "), "message"))).alias("notes"),
    )
    how = "left" if settings.send_empty_digest else "inner"
    joined = (
        runs.select("run_id")
        .join(gathered, "run_id", how)
        .join(notes, "run_id", "left")
        .join(stats, "run_id", "left")
        .withColumn("job_count", F.coalesce("job_count", F.lit(0)))
        .withColumn("issues", F.coalesce("issues", F.lit(0)))
    )
    day = as_timestamp(as_of)
    plural = F.when(F.col("job_count") == 1, "").otherwise("s")
    count = F.col("job_count").cast("string")
    subject = F.when(
        F.col("job_count") > 0,
        F.concat(F.lit(settings.subject_prefix + " "), count, F.lit(" job"), plural, F.lit(" worth a look - "), short_date(day)),
    ).otherwise(F.concat(F.lit(settings.subject_prefix + " No strong new matches - "), short_date(day)))

    def block(name: str) -> list[Column]:
        texts = F.transform(F.filter("blocks", lambda b: b["section"] == name), lambda b: b["text"])
        body = F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.array_join(texts, "\n")).otherwise("(none)")
        return [F.lit(name), body, F.lit("")]

    new = F.coalesce("total_new", F.lit(0)).cast("string")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Listings of the day - "), F.date_format(day, "EEEE, MMMM d")),
        F.concat(count, F.lit(" role"), plural, F.lit(" worth a look from "), new, F.lit(" new listings.")),
        F.lit(""),
        *[c for name in SECTIONS for c in block(name)],
        F.lit("Search details"),
        F.concat(
            F.lit("- Checked "), F.coalesce("total_collected", F.lit(0)).cast("string"),
            F.lit(" listings and found "), new, F.lit(" jobs you had not seen before."),
        ),
        F.concat(F.lit("- Source issues: "), F.col("issues").cast("string")),
        F.lit(""),
        F.when(F.col("issues") > 0, F.concat_ws("\n", F.lit("Source notes"), F.array_join("notes", "\n"))),
    )
    return joined.select(
        "run_id",
        F.lit(settings.recipient).alias("recipient"),
        subject.alias("subject"),
        text.alias("body_text"),
        F.col("job_count").cast("int").alias("job_count"),
        day.alias("sent_at"),
    )
