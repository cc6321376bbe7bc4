"""Date columns: parsing of posted dates, ages and freshness. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers above this are read as milliseconds, below as seconds.
MILLISECOND_LIMIT = 2e10

# Accepted text forms besides ISO 8601 (guard, format).
TEXT_FORMATS = (
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "EEE, d MMM yyyy HH:mm:ss Z"),
)


def as_timestamp(value: Column | str) -> Column:
    """A literal or column as a UTC timestamp."""
    return F.lit(value).cast("timestamp")


def from_epoch(number: Column) -> Column:
    """Epoch seconds or milliseconds, told apart by size."""
    seconds = F.when(F.abs(number) > MILLISECOND_LIMIT, number / 1000).otherwise(number)
    micros = F.round(seconds * 1_000_000).try_cast("bigint")
    return F.when(F.abs(number) < 2e14, F.timestamp_micros(micros))


def parse_posted(text: Column) -> Column:
    """Posted date from ISO, epoch or a few written forms; null when it cannot be read."""
    bare = F.trim(text)
    parsed = F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), from_epoch(bare.try_cast("double")))
    # The cast accepts more than a date (a bare year, a time of day), so the shape is checked first.
    parsed = parsed.when(bare.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"), bare.try_cast("timestamp"))
    # The format letter d does not accept a week-day name in parse mode; it is cut off instead.
    for guard, fmt in TEXT_FORMATS:
        value = F.regexp_replace(bare, r"^[A-Z][a-z]{2}, ", "") if fmt.startswith("EEE") else bare
        parsed = parsed.when(bare.rlike(guard), F.try_to_timestamp(value, F.lit(fmt.removeprefix("EEE, "))))
    return parsed


def within_days(moment: Column, as_of: Column | str, days: int | Column) -> Column:
    """Unknown passes; otherwise not older than ``days`` before ``as_of`` (inclusive)."""
    oldest = as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    return moment.isNull() | (moment >= oldest)


def age_in_days(cell: Column) -> Column:
    """``12d`` as 12; anything else is null."""
    return F.regexp_extract(F.trim(cell), r"(?i)^(\d+)d$", 1).try_cast("int")


def days_before(as_of: Column | str, days: Column) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(days)


def days_since(moment: Column, as_of: Column | str) -> Column:
    """Whole days from ``moment`` to ``as_of``, never negative."""
    micros = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(moment)
    return F.greatest(F.lit(0), F.floor(micros / 86_400_000_000)).cast("int")


def short_date(moment: Column) -> Column:
    return F.date_format(moment, "MMM d")
