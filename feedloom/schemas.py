"""Column layouts that the stages hand to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every landed listing keeps (source_ordinal, position): the only order the engine relies on.
COLLECTED = {
    "source_ordinal": "int",
    "position": "bigint",
    "source_name": "string",
    "source_type": "string",
    "source_url": "string",
    "apply_url": "string",
    "company_name": "string",
    "title": "string",
    "external_job_id": "string",
    "location_text": "string",
    "posted_at": "timestamp",
    "description_text": "string",
    "job_family": "string",
    "employment_type": "string",
    "search_query": "string",
    "fetched_at": "timestamp",
    "confidence": "double",
    "metadata": "map<string,string>",
}

STATE_DDL = """
    job_id string, canonical_key string, company_id bigint, raw_job_id string, source_name string,
    source_type string, source_url string, apply_url string, company_name string, title string,
    title_normalized string, external_job_id string, job_family string, location_text string,
    location_normalized string, is_remote boolean, posted_at timestamp, description_text string,
    description_hash string, content_hash string, confidence double, current_status string,
    application_status string, applied_at timestamp, application_notes string,
    application_url string, reopened_count int, first_seen_at timestamp, last_seen_at timestamp,
    metadata map<string,string>, seen_in_sources array<string>,
    job_details struct<salary:string,work_mode:string,sponsorship:string,citizenship:string,
        clearance:string,graduation_years:array<string>,application_deadline:string>
"""

SCORES_DDL = """
    run_id string, job_id string, fit_score int, difficulty_score int, recommendation string,
    fit_summary string, difficulty_summary string, top_matching_skills array<string>,
    missing_or_weaker_skills array<string>, tags array<string>, scorer string,
    scorer_confidence double, created_at timestamp
"""

RUNS_DDL = """
    run_id string, status string, started_at timestamp, completed_at timestamp,
    total_collected bigint, total_normalized bigint, total_new bigint, total_reopened bigint,
    total_high_signal bigint, total_errors bigint, error string
"""

WEIGHTS_DDL = "run_id string, dimension string, key string, weight bigint"

HEALTH_DDL = """
    run_id string, source_name string, status string, total_available bigint,
    relevant_jobs bigint, error string
"""

ERRORS_DDL = "run_id string, source_name string, stage string, message string, detail string"


def select_collected(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the collected layout; columns not given are taken from ``df`` or left null."""
    out = []
    for name, kind in COLLECTED.items():
        if name in columns:
            value = columns[name]
        elif name in df.columns:
            value = F.col(name)
        else:
            value = F.lit(1.0) if name == "confidence" else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*out)
