"""Per-source outcomes, caps and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEALTHY, FAILED, UNSUPPORTED, STALE = "healthy", "failed", "unsupported", "stale"
PROBLEM_STATES = (FAILED, STALE, UNSUPPORTED)


def cap_per_collector(df: DataFrame, collector: str, limit: int | None) -> DataFrame:
    """First listings of every collector in landing order; all of them without a limit.

    The rank test becomes a window group limit: each task drops all but ``limit`` rows of a
    collector before the shuffle, so a collector with most of the rows costs no more than others.
    """
    if limit is None:
        return df
    order = Window.partitionBy(collector).orderBy("source_ordinal", "position")
    return df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit).drop("_place")


def left_out(df: DataFrame, collector: str, limit: int | None) -> DataFrame:
    """(collector, listed, dropped) of every collector that a cap cuts."""
    counts = df.groupBy(F.col(collector).alias("collector")).agg(F.count(F.lit(1)).alias("listed"))
    dropped = F.lit(0) if limit is None else F.greatest(F.col("listed") - limit, F.lit(0))
    return counts.withColumn("dropped", dropped.cast("bigint")).filter("dropped > 0")


def board_outcomes(boards: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per configured board, also where nothing was landed.

    ``boards`` is the source list (source_name, supported); ``judged`` the postings with ``passes``.
    """
    seen = judged.groupBy("source_name").agg(
        F.count("position").alias("available"),
        F.count_if(F.coalesce(F.col("passes"), F.lit(False))).alias("relevant"),
        F.max("failure").alias("failure"),
    )
    joined = boards.join(seen, "source_name", "left")
    landed = F.col("available").isNotNull()
    status = (
        F.when(~F.col("supported"), UNSUPPORTED)
        .when(~landed | F.col("failure").isNotNull(), FAILED)
        .otherwise(HEALTHY)
    )
    healthy = F.col("status") == HEALTHY
    return joined.withColumn("status", status).select(
        "source_name",
        "status",
        F.when(healthy, F.col("available")).alias("total_available"),
        F.when(healthy, F.col("relevant")).otherwise(F.lit(0)).alias("relevant_jobs"),
        F.when(
            F.col("status") == FAILED, F.coalesce(F.col("failure"), F.lit("no payload was landed"))
        ).alias("error"),
    )


def feed_outcomes(sources: DataFrame, available: DataFrame, relevant: DataFrame) -> DataFrame:
    """Outcome of feeds: ``sources`` (source_name, landed, readable) with two count tables."""
    joined = sources.join(available, "source_name", "left").join(relevant, "source_name", "left")
    ok = F.col("landed") & F.col("readable")
    return joined.select(
        "source_name",
        F.when(ok, HEALTHY).otherwise(FAILED).alias("status"),
        F.when(ok, F.coalesce(F.col("total_available"), F.lit(0))).cast("bigint").alias("total_available"),
        F.coalesce(F.col("relevant_jobs"), F.lit(0)).cast("bigint").alias("relevant_jobs"),
        F.when(~F.col("landed"), "no payload was landed").when(~ok, "payload is not readable").alias("error"),
    )


def source_errors(outcomes: DataFrame) -> DataFrame:
    """Failed sources as error rows."""
    return outcomes.filter(F.col("status") == FAILED).select(
        "source_name",
        F.lit("collect").alias("stage"),
        F.lit("source failed").alias("message"),
        F.col("error").alias("detail"),
    )


def empty_source_findings(outcomes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Primary feeds (structured, markdown) that gave no relevant listing."""
    primary = kinds.filter(F.col("kind").isin("structured", "markdown")).select("source_name")
    return (
        outcomes.join(primary, "source_name", "left_semi")
        .filter(F.col("relevant_jobs") == 0)
        .select(
            "source_name",
            F.lit("health").alias("stage"),
            F.lit("primary source returned zero relevant listings").alias("message"),
            F.lit(None).cast("string").alias("detail"),
        )
    )
