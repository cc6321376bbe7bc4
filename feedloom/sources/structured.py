"""JSON and CSV feeds with a configurable column mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import rules
from feedloom.functions import times
from feedloom.functions.relevance import sparse_context
from feedloom.functions.text import materialize, null_if_empty, strip
from feedloom.functions.urls import on_domain
from feedloom.schemas import select_collected
from feedloom.sources.gates import listing_gate

FLAGS = ("active", "is_visible", "is_closed")
TEXT_KEYS = ("company_key", "title_key", "url_key", "location_key", "posted_at_key", "description_key", "job_id_key")


def _leaf_schema(path: str, leaf: T.DataType) -> T.DataType:
    kind = leaf
    for part in reversed([p for p in path.split(".") if p]):
        kind = T.ArrayType(kind) if part.isdigit() else T.StructType([T.StructField(part, kind)])
    return kind


def _follow(parsed: Column, path: str) -> Column:
    for part in [p for p in path.split(".") if p]:
        parsed = F.get(parsed, F.lit(int(part))) if part.isdigit() else parsed.getField(part)
    return parsed


def extract_rows(body: Column, path: str) -> Column:
    """Raw JSON texts of the rows below a dotted path; null where there is no list.

    Only the rows' outlines are read here; each row is parsed after it became a row of its own.
    """
    schema = _leaf_schema(path, T.ArrayType(T.StringType()))
    return _follow(F.from_json(body, schema), path)


def has_path(body: Column, path: str) -> Column:
    """True where the payload is readable and the path exists, whatever lies there."""
    return _follow(F.from_json(body, _leaf_schema(path, T.StringType())), path).isNotNull()


def parsed_payloads(payloads: DataFrame, feed: rules.StructuredFeed) -> DataFrame:
    """(source_ordinal, fetched_at, raws, readable) of each payload, for listings and outcome alike.

    ``raws`` holds the rows' JSON texts, null where there is no list; ``readable`` tells that the path exists. A payload with a
    list is parsed once for both.
    """
    read = materialize(payloads.select("source_ordinal", "fetched_at", "body"), raws=extract_rows(F.col("body"), feed.job_path))
    present = F.when(F.col("raws").isNotNull(), True).otherwise(has_path(F.col("body"), feed.job_path))
    return read.select("source_ordinal", "fetched_at", "raws", F.coalesce(present, F.lit(False)).alias("readable"))


def parsed_rows(parsed: DataFrame) -> DataFrame:
    """What ``feed_rows`` gives, of payloads that are parsed."""
    return parsed.select("source_ordinal", "fetched_at", F.posexplode("raws").alias("position", "raw"))


def feed_rows(payloads: DataFrame, feed: rules.StructuredFeed) -> DataFrame:
    """One row per feed entry: ``source_ordinal``, ``position``, ``raw``, ``fetched_at``.

    Payloads without a list give no rows.
    """
    return payloads.select(
        "source_ordinal",
        "fetched_at",
        F.posexplode(extract_rows(F.col("body"), feed.job_path)).alias("position", "raw"),
    )


def _keys(feed: rules.StructuredFeed) -> dict[str, str]:
    return {name: getattr(feed, name) for name in TEXT_KEYS if getattr(feed, name)}


def map_json_rows(rows: DataFrame, feed: rules.StructuredFeed) -> DataFrame:
    """Configured fields of every entry, with flags read as real booleans only."""
    keys = _keys(feed)
    texts = T.StructType([T.StructField(k, T.StringType()) for k in dict.fromkeys(keys.values())])
    flag_names = [*FLAGS, *([feed.closed_key] if feed.closed_key else [])]
    flags = T.StructType([T.StructField(k, T.BooleanType()) for k in dict.fromkeys(flag_names)])
    place = T.StructType([T.StructField(feed.location_key, T.ArrayType(T.StringType()))])
    raw = F.col("raw")
    parsed = materialize(
        rows,
        item=F.from_json(raw, texts),
        flags=F.from_json(raw, flags),
        places=F.from_json(raw, place).getField(feed.location_key),
    )

    def text(name: str) -> Column:
        return F.col("item").getField(keys[name]) if name in keys else F.lit(None).cast("string")

    def flag(name: str, value: bool) -> Column:
        return F.coalesce(F.col("flags").getField(name) == value, F.lit(False))

    closed = flag("active", False) | flag("is_visible", False) | flag("is_closed", True)
    if feed.closed_key:
        closed = closed | flag(feed.closed_key, True)
    location = F.when(F.col("places").isNotNull(), F.array_join("places", ", ")).otherwise(strip(text("location_key")))
    return _mapped(parsed, feed, text, location, closed)


def map_csv_rows(rows: DataFrame, feed: rules.StructuredFeed) -> DataFrame:
    """The same mapping for rows that already have named text columns."""
    keys = _keys(feed)

    def text(name: str) -> Column:
        present = name in keys and keys[name] in rows.columns
        return F.col(f"`{keys[name]}`") if present else F.lit(None).cast("string")

    return _mapped(rows, feed, text, strip(text("location_key")), F.lit(False))


def _mapped(rows: DataFrame, feed: rules.StructuredFeed, text, location: Column, closed: Column) -> DataFrame:
    return rows.select(
        "source_ordinal",
        "position",
        "fetched_at",
        F.lit(feed.name).alias("source_name"),
        F.lit(feed.url).alias("source_url"),
        F.coalesce(strip(text("title_key")), F.lit("")).alias("title"),
        text("company_key").alias("company_name"),
        text("url_key").alias("apply_url"),
        null_if_empty(location).alias("location_text"),
        times.parse_posted(text("posted_at_key")).alias("posted_at"),
        F.coalesce(strip(text("description_key")), F.lit("")).alias("description_text"),
        null_if_empty(strip(text("job_id_key"))).alias("external_job_id"),
        closed.alias("closed"),
    )


def entry_gate(
    feed_name: Column,
    feed_url: Column,
    settings: rules.Settings,
    as_of: str,
    aggregators: tuple[str, ...] = rules.FEED_AGGREGATORS,
) -> Column:
    """Open, complete, recent, direct and relevant entries; cheap tests come first."""
    limits = settings.limits
    return (
        ~F.col("closed")
        & (F.col("title") != "")
        & (F.coalesce(F.col("company_name"), F.lit("")) != "")
        & (F.coalesce(F.col("apply_url"), F.lit("")) != "")
        & times.within_days(F.col("posted_at"), as_of, limits.max_age_days)
        & ~on_domain(F.col("apply_url"), aggregators)
        & listing_gate(settings.filters, sparse_context(F.col("description_text"), feed_name, feed_url))
    )


def collect_feed(
    mapped: DataFrame, settings: rules.Settings, as_of: str, file_format: str = "json"
) -> DataFrame:
    """Mapped entries that pass the gate, in the collected layout."""
    once = materialize(
        mapped, passes=entry_gate(F.col("source_name"), F.col("source_url"), settings, as_of)
    )
    return select_collected(
        once.filter("passes"),
        source_type=F.lit("structured"),
        metadata=F.create_map(F.lit("feed"), F.col("source_name"), F.lit("format"), F.lit(file_format)),
    )


def read_csv_feed(spark: SparkSession, path: str, source_ordinal: int, fetched_at: str) -> DataFrame:
    """Landed CSV files with a header; quoted line breaks are allowed.

    Positions are taken in the scan itself, before anything can move rows.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumns(
        {
            "source_ordinal": F.lit(source_ordinal),
            "position": F.monotonically_increasing_id(),
            "fetched_at": times.as_timestamp(fetched_at),
        }
    )
