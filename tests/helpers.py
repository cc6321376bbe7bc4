"""Small helpers for literal tests."""

from pyspark.sql import functions as F

from feedloom import rules

FILTERS = rules.Filters(excluded_families=("Analyst", "Embedded", "Firmware", "Site Reliability"))
PROFILE = rules.Profile(skills=("Python", "TypeScript", "React", "Node.js", "Docker", "SQL"))


def one(spark, column):
    """Value of a column expression over literals."""
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def lit(value):
    return F.lit(value).cast("string") if value is None or isinstance(value, str) else F.lit(value)
