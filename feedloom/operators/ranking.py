"""Ranking of actionable listings: tiers, rule scores, external scores, previous scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.scoring import score
from feedloom.functions.text import plain_summary
from feedloom.functions.times import within_days
from feedloom.operators.feedback import apply_feedback
from feedloom.runtime import lookup_join

EXTERNAL_DDL = (
    "fit_score int, difficulty_score int, recommendation string, fit_summary string, "
    "difficulty_summary string, top_matching_skills array<string>, "
    "missing_or_weaker_skills array<string>, tags array<string>, scorer_confidence double"
)
RANKING_FIELDS = tuple(f.split(" ")[0] for f in EXTERNAL_DDL.split(", "))
RECOMMENDATIONS = (rules.APPLY_NOW, rules.APPLY_IF_INTERESTED, rules.LOW_PRIORITY, rules.SKIP)

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def company_tiers(companies: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """Tier per lower-case company name; names on the priority list are tier 1."""
    spark = companies.sparkSession
    known = companies.select(F.lower("name").alias("_name"), F.coalesce("priority_tier", F.lit(3)).alias("tier"))
    if priority:
        listed = spark.createDataFrame([(p.lower(), 1) for p in priority], "_name string, tier int")
        known = known.unionByName(listed)
        named = F.col("_name").isin(*[p.lower() for p in priority])
        known = known.withColumn("tier", F.when(named, 1).otherwise(F.col("tier")))
    return known.groupBy("_name").agg(F.min("tier").alias("company_tier"))


def with_tier(jobs: DataFrame, tiers: DataFrame, job_key: str = "canonical_key") -> DataFrame:
    keyed = jobs.withColumn("_name", F.lower("company_name"))
    joined = lookup_join(keyed, tiers, ["_name"], salt_by=job_key).drop("_name")
    return joined.withColumn("company_tier", F.coalesce("company_tier", F.lit(3)))


def actionable(merged: DataFrame, as_of: str, limits: rules.Limits) -> DataFrame:
    """New or reopened listings that are fresh enough for a digest."""
    return merged.filter(
        F.col("lifecycle_state").isin(*rules.ACTIONABLE)
        & within_days(F.col("posted_at"), as_of, limits.digest_max_age_days)
    )


def external_candidates(ranked: DataFrame, limits: rules.Limits) -> DataFrame:
    """Listings worth an external score; the test is placed below the Python stage by hand."""
    return ranked.filter(F.col("fit_score") >= limits.scorer_min_fit)


def _halved(rows: pd.DataFrame, scorer: Scorer, job_key: str) -> list[pd.DataFrame]:
    """Scores of the rows that the scorer takes. One bad row of n costs about 2 log2(n) more calls."""
    try:
        found = scorer(rows).reindex(columns=[job_key, *RANKING_FIELDS])
        # At most one score per row that was asked for.
        return [found[found[job_key].isin(rows[job_key])].drop_duplicates(job_key)]
    except Exception:
        middle = len(rows) // 2
        return [s for half in (rows.iloc[:middle], rows.iloc[middle:]) for s in _halved(half, scorer, job_key)] if middle else []


def external_scores(
    candidates: DataFrame, scorer: Scorer, job_key: str = "canonical_key", batch: int = rules.Limits.scorer_batch
) -> DataFrame:
    """Scores of a user-supplied scorer, ``batch`` rows at a time.

    ``scorer`` takes candidate rows and returns rows with the job key and the ranking fields. A batch that
    fails is tried again in halves; rows that fail alone, or are missing, give no score.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                yield from _halved(rows.iloc[start : start + batch], scorer, job_key)

    return candidates.mapInPandas(run, f"{job_key} string, {EXTERNAL_DDL}")


def _inside() -> Column:
    """A score within its bounds."""
    inside = (
        F.col("fit_score").between(0, 100)
        & F.col("difficulty_score").between(0, 100)
        & F.col("scorer_confidence").between(0, 1)
        & F.col("recommendation").isin(*RECOMMENDATIONS)
    )
    return F.coalesce(inside, F.lit(False))


def external_outcomes(candidates: DataFrame, scores: DataFrame, job_key: str = "canonical_key") -> DataFrame:
    """(outcome, n): candidates that were scored, whose score was out of bounds (refused), or that have none (failed)."""
    known = scores.select(F.col(job_key).alias("_key"), _inside().alias("_inside"))
    joined = candidates.select(job_key).join(known, F.col(job_key) == F.col("_key"), "left")
    outcome = F.when(F.col("_key").isNull(), "failed").when(F.col("_inside"), "scored").otherwise("refused")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def valid_external(scores: DataFrame) -> DataFrame:
    """Scores within bounds; texts are cleaned."""
    return scores.filter(_inside()).withColumns(
        {c: plain_summary(F.col(c)) for c in ("fit_summary", "difficulty_summary")}
    )


def merge_external(
    ranked: DataFrame, scores: DataFrame, name: str = "external", job_key: str = "canonical_key"
) -> DataFrame:
    """External scores replace rule scores; listings without one keep theirs."""
    found = valid_external(scores).select(job_key, F.struct(*RANKING_FIELDS).alias("ext"))
    joined = ranked.join(found, job_key, "left")
    hit = F.col("ext").isNotNull()
    changed = {c: F.when(hit, F.col(f"ext.{c}")).otherwise(F.col(c)) for c in RANKING_FIELDS}
    changed["scorer"] = F.when(hit, F.lit(name)).otherwise(F.col("scorer"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in ranked.columns])


def previous_scores(scores: DataFrame, run_id: str) -> DataFrame:
    """Fit of the latest earlier score per job, the given run left out."""
    return (
        scores.filter(F.col("run_id") != run_id)
        .groupBy("job_id")
        .agg(F.max_by("fit_score", F.struct("created_at", "run_id")).alias("prev_fit_score"))
    )


def rank(
    jobs: DataFrame,
    tiers: DataFrame,
    weights: DataFrame,
    history: DataFrame,
    run_id: str,
    settings: rules.Settings,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Rule score, feedback, optional external score, and the previous fit of known jobs."""
    ranked = apply_feedback(score(with_tier(jobs, tiers), settings.profile), weights)
    if scorer is not None:
        external = external_scores(external_candidates(ranked, settings.limits), scorer)
        ranked = _external_then_feedback(ranked, external, weights)
    # The earlier scores of only these jobs are searched; their keys do not need the scoring.
    known = history.join(jobs.select("job_id"), "job_id", "left_semi")
    joined = ranked.join(previous_scores(known, run_id), "job_id", "left")
    return joined.withColumn(
        "prev_fit_score", F.when(F.col("lifecycle_state") != rules.NEW, F.col("prev_fit_score"))
    )


def _external_then_feedback(ranked: DataFrame, external: DataFrame, weights: DataFrame) -> DataFrame:
    """Feedback is applied to external scores as well; rule scores already have it."""
    merged = merge_external(ranked, external)
    scored = apply_feedback(merged.filter(F.col("scorer") != "heuristic"), weights)
    return merged.filter(F.col("scorer") == "heuristic").unionByName(scored)


def digest_rows(jobs: DataFrame, scores: DataFrame, run_id: str) -> DataFrame:
    """Stored jobs with the scores of one run."""
    of_run = scores.filter(F.col("run_id") == run_id).drop("run_id")
    return jobs.join(of_run, "job_id").withColumn("lifecycle_state", F.col("current_status"))
