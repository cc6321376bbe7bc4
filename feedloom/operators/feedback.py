"""Preferences learned from user decisions, and their bounded effect on scores."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.scoring import mismatch_without_place, recommend
from feedloom.functions.text import materialize
from feedloom.runtime import lookup_join

COMPANY = "company"
# Weights of tags, skills and work modes up to this number become a literal.
CATALOG_ROWS = 2_000


def latest_scores(scores: DataFrame) -> DataFrame:
    """Last score row of every job."""
    fields = [c for c in scores.columns if c != "job_id"]
    return scores.groupBy("job_id").agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "run_id")).alias("latest")
    ).select("job_id", "latest.*")


def observations(state: DataFrame, scores: DataFrame) -> DataFrame:
    """Decided jobs with sign, company, tags, skills and work mode."""
    decided = state.filter(F.col("current_status").isin(*rules.USER_STATES)).select(
        "job_id",
        F.when(F.col("current_status") == rules.IGNORED, -1).otherwise(1).alias("sign"),
        F.lower("company_name").alias("company"),
        F.col("job_details.work_mode").alias("work_mode"),
    )
    # Only scores of decided jobs take part in the search for the latest one.
    relevant = scores.join(decided.select("job_id"), "job_id", "left_semi")
    latest = latest_scores(relevant.select("job_id", "run_id", "created_at", "tags", "top_matching_skills"))
    return decided.join(latest.select("job_id", "tags", "top_matching_skills"), "job_id", "left")


def _keys(company: Column, tags: Column, skills: Column, mode: Column) -> Column:
    """Array of (dimension, key) that one job contributes to."""

    def each(values: Column, dimension: str) -> Column:
        pairs = F.transform(
            F.array_distinct(values), lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("key"))
        )
        return F.coalesce(pairs, F.expr("cast(array() as array<struct<dimension:string,key:string>>)"))

    known_mode = F.when((mode != "") & (mode != rules.UNSPECIFIED), F.array(mode))
    return F.concat(
        each(F.array(company), COMPANY), each(tags, "tag"), each(skills, "skill"), each(known_mode, "work_mode")
    )


def feedback_weights(observed: DataFrame, min_samples: int = rules.Limits.feedback_min_samples) -> DataFrame:
    """``(dimension, key, weight)``; empty below the minimum number of decisions."""
    keys = _keys(F.col("company"), F.col("tags"), F.col("top_matching_skills"), F.col("work_mode"))
    summed = (
        observed.select("sign", F.inline(keys))
        .groupBy("dimension", "key")
        .agg(F.sum("sign").alias("weight"))
    )
    samples = observed.agg(F.count(F.lit(1))).scalar()
    return summed.filter(samples >= min_samples)


def catalog_weights(weights: DataFrame, max_rows: int = CATALOG_ROWS) -> Column | None:
    """Weights of tags, skills and work modes as a literal map, or null if there are too many.

    These keys come from rule tables, so there are a few dozen; no more than ``max_rows`` are read.
    """
    rows = (
        weights.filter(F.col("dimension") != COMPANY)
        .select(F.concat_ws("/", "dimension", "key").alias("k"), F.col("weight").cast("bigint").alias("w"))
        .limit(max_rows + 1)
        .collect()
    )
    if len(rows) > max_rows:
        return None
    return F.from_json(F.lit(json.dumps({r.k: r.w for r in rows})), "map<string,bigint>")


def _sum_in_row(known: Column) -> Column:
    """Sum of the catalog weights of one job, without leaving its row."""
    keys = _keys(F.lit(None).cast("string"), F.col("tags"), F.col("top_matching_skills"), F.col("job_details.work_mode"))
    return F.aggregate(
        F.filter(keys, lambda k: k["dimension"] != COMPANY),
        F.lit(0).cast("bigint"),
        lambda total, k: total
        + F.coalesce(F.try_element_at(known, F.concat_ws("/", k["dimension"], k["key"])), F.lit(0)),
    )


def _sum_by_join(ranked: DataFrame, weights: DataFrame, job_key: str) -> DataFrame:
    """The same sum for a catalog too large for a literal: spread keys, join, add up per job."""
    keys = _keys(F.lit(None).cast("string"), F.col("tags"), F.col("top_matching_skills"), F.col("job_details.work_mode"))
    spread = ranked.select(job_key, F.inline(F.filter(keys, lambda k: k["dimension"] != COMPANY)))
    found = lookup_join(spread, weights.filter(F.col("dimension") != COMPANY), ["dimension", "key"], "inner", job_key)
    return found.groupBy(job_key).agg(F.sum("weight").alias("_catalog"))


def adjusted(
    ranked: DataFrame,
    weights: DataFrame,
    job_key: str = "canonical_key",
    bound: int = rules.Limits.feedback_bound,
    max_catalog: int = CATALOG_ROWS,
) -> DataFrame:
    """Add ``adjustment``, the bounded sum of a job's learned weights; the company counts twice.

    A job has one company, so its weight is a plain lookup; popular companies are salted when the
    weights are too many to broadcast.
    """
    companies = weights.filter(F.col("dimension") == COMPANY).select(
        F.col("key").alias("_company"), F.col("weight").alias("_company_weight")
    )
    keyed = ranked.withColumn("_company", F.lower("company_name"))
    joined = lookup_join(keyed, companies, ["_company"], salt_by=job_key)
    known = catalog_weights(weights, max_catalog)
    if known is not None:
        catalog = _sum_in_row(known)
    else:
        joined = joined.join(_sum_by_join(ranked, weights, job_key), job_key, "left")
        catalog = F.coalesce("_catalog", F.lit(0))
    raw = F.coalesce("_company_weight", F.lit(0)) * 2 + catalog
    bounded = F.greatest(F.lit(-bound), F.least(F.lit(bound), raw)).cast("int")
    return materialize(joined, adjustment=bounded).drop("_company", "_company_weight", "_catalog")


def apply_feedback(
    ranked: DataFrame, weights: DataFrame, job_key: str = "canonical_key", bound: int = rules.Limits.feedback_bound
) -> DataFrame:
    """Scores after feedback: fit moved within 0..100, recommendation and tags follow."""
    rows = adjusted(ranked, weights, job_key, bound)
    moved = F.col("adjustment") != 0
    fit = F.greatest(F.lit(0), F.least(F.lit(100), F.col("fit_score") + F.col("adjustment"))).cast("int")
    scored = materialize(rows, new_fit=F.when(moved, fit).otherwise(F.col("fit_score")))
    mismatch = mismatch_without_place(F.col("title"), F.col("description_text"))
    changed = {
        "fit_score": F.col("new_fit"),
        "recommendation": F.when(moved, recommend(F.col("new_fit"), mismatch)).otherwise(F.col("recommendation")),
        "tags": F.when(
            moved, F.array_sort(F.array_union("tags", F.array(F.lit("feedback_adjusted"))))
        ).otherwise(F.col("tags")),
    }
    return scored.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in ranked.columns])
