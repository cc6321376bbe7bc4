"""Run ledger, source health over time and run coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom import rules
from feedloom.sources.outcomes import HEALTHY, PROBLEM_STATES, STALE

COMPLETED = "completed"


def recent_completed_runs(runs: DataFrame, limit: int) -> DataFrame:
    return (
        runs.filter(F.col("status") == COMPLETED)
        .orderBy(F.col("started_at").desc(), F.col("run_id").desc())
        .limit(limit)
    )


def stale_now(current: DataFrame, history: DataFrame, runs: DataFrame, streak: int = 2) -> DataFrame:
    """Sources that are healthy but empty now and were empty in each of the last ``streak`` runs.

    Fewer completed runs than ``streak`` means that nothing is stale yet.
    """
    last = recent_completed_runs(runs, streak).select("run_id")
    empty_before = (
        history.join(F.broadcast(last), "run_id", "left_semi")
        .filter(F.col("total_available") == 0)
        .groupBy("source_name")
        .agg(F.count_distinct("run_id").alias("empty_runs"))
        .filter(F.col("empty_runs") == streak)
        .select("source_name")
    )
    return current.filter((F.col("status") == HEALTHY) & (F.col("total_available") == 0)).join(
        empty_before, "source_name", "left_semi"
    )


def mark_stale(current: DataFrame, stale: DataFrame) -> DataFrame:
    flagged = stale.select("source_name", F.lit(True).alias("_stale"))
    return current.join(flagged, "source_name", "left").select(
        *[
            F.when(F.col("_stale"), STALE).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c)
            for c in current.columns
        ]
    )


def stale_findings(stale: DataFrame) -> DataFrame:
    return stale.select(
        "source_name",
        F.lit("health").alias("stage"),
        F.lit("source returned zero listings for three consecutive runs").alias("message"),
        F.lit(None).cast("string").alias("detail"),
    )


def run_sequence(runs: DataFrame) -> DataFrame:
    """Completed runs numbered by start. The ledger has one row per run, a few hundred per year."""
    order = Window.orderBy("started_at", "run_id")
    return runs.filter(F.col("status") == COMPLETED).select(
        "run_id", F.row_number().over(order).alias("run_seq")
    )


def stale_history(health: DataFrame, runs: DataFrame, streak: int = 2) -> DataFrame:
    """Every (run, source) at which a source was stale, over the whole history.

    An empty observation vouches for its own run and the next ``streak`` runs; a source is stale
    where all of them vouch. Missing rows break the streak by themselves, without a grid of all
    runs and sources, and the counts combine before the shuffle.
    """
    numbered = health.join(F.broadcast(run_sequence(runs)), "run_id")
    empty = numbered.filter(F.col("total_available") == 0)
    vouchers = empty.select(
        "source_name",
        F.posexplode(F.sequence(F.col("run_seq"), F.col("run_seq") + streak)).alias("age", "run_seq"),
        "run_id",
        "status",
    )
    return (
        vouchers.groupBy("source_name", "run_seq")
        .agg(
            F.count_distinct("age").alias("vouched"),
            F.max(F.when((F.col("age") == 0) & (F.col("status") == HEALTHY), F.col("run_id"))).alias("run_id"),
        )
        .filter((F.col("vouched") == streak + 1) & F.col("run_id").isNotNull())
        .select("run_id", "source_name")
    )


def problem_sources(health: DataFrame, runs: DataFrame) -> DataFrame:
    """The sources in trouble in the latest completed run, one row each, with the counts of that run.

    A run without any has one row with a null name. Names are never gathered into one value.
    """
    last = recent_completed_runs(runs, 1).select("run_id")
    bad = F.max(F.col("status").isin(*PROBLEM_STATES)).alias("bad")
    # One row: the latest run.
    sources = health.join(F.broadcast(last), "run_id", "left_semi").groupBy("run_id", "source_name").agg(bad)
    counts = sources.groupBy("run_id").agg(
        F.count("source_name").alias("sources_checked"), F.count_if("bad").alias("need_attention")
    )
    return counts.join(sources.filter("bad").select("run_id", "source_name"), "run_id", "left")


def run_stats(ranked: DataFrame, thresholds: rules.Thresholds) -> DataFrame:
    """Counts over actionable, ranked listings."""
    return ranked.agg(
        F.count_if(F.col("lifecycle_state") == rules.NEW).alias("total_new"),
        F.count_if(F.col("lifecycle_state") == rules.REOPENED).alias("total_reopened"),
        F.count_if(F.col("fit_score") >= thresholds.high_signal_fit).alias("total_high_signal"),
    )


def covered_dates(runs: DataFrame, timezone: str) -> DataFrame:
    """Local dates with at least one completed run, daylight saving respected."""
    local = F.to_date(F.from_utc_timestamp("started_at", timezone))
    return (
        runs.filter(F.col("status") == COMPLETED)
        .groupBy(local.alias("local_date"))
        .agg(F.count(F.lit(1)).alias("completed_runs"))
    )


def uncovered_dates(runs: DataFrame, timezone: str) -> DataFrame:
    """Local dates between the first and last run on which no run completed."""
    local = F.to_date(F.from_utc_timestamp("started_at", timezone))
    spine = runs.agg(F.min(local).alias("a"), F.max(local).alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("local_date")
    )
    return spine.join(covered_dates(runs, timezone).select("local_date"), "local_date", "left_anti")


def should_run(runs: DataFrame, timezone: str, now: str, limit: int = 5) -> DataFrame:
    """One row: is a run due on the local date of ``now``, judged by the last runs."""
    today = F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), timezone))
    started = F.to_date(F.from_utc_timestamp("started_at", timezone))
    return recent_completed_runs(runs, limit).agg(
        (F.count_if(started == today) == 0).alias("run_due")
    )


def recently_seen(state: DataFrame, limit: int = 100) -> DataFrame:
    return state.orderBy(F.col("last_seen_at").desc(), "job_id").limit(limit)
