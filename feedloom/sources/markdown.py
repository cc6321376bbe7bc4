"""Markdown job tables. The header in force is found inside the row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions import times
from feedloom.functions.text import first_link, materialize, null_if_empty, strip, strip_markup
from feedloom.schemas import select_collected
from feedloom.sources.gates import listing_gate

# Accepted column names, first match wins.
TITLE_NAMES = ("position", "role", "job title")
LINK_NAMES = ("posting", "application", "apply")
CONTINUED = "↳"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), strip)


def _names(line: Column) -> Column:
    return F.transform(_cells(line), lambda cell: F.lower(strip_markup(cell)))


def _is_header(line: Column) -> Column:
    # The cheap test on the whole line keeps cell parsing off ordinary rows.
    low = F.lower(line)
    names = _names(line)
    return (
        low.contains("company")
        & F.array_contains(names, "company")
        & F.arrays_overlap(names, F.array(*[F.lit(n) for n in TITLE_NAMES]))
    )


def table_lines(payloads: DataFrame) -> DataFrame:
    """One row per table line that is not a header, with the names of the last header before it.

    A document is cut at its headers into blocks of lines, and a block into lines: every line is touched once, however many
    headers there are.
    """
    lines = F.transform(
        F.split("body", "\r\n|\r|\n"), lambda line, i: F.struct(i.alias("i"), strip(line).alias("line"))
    )
    piped = F.filter(lines, lambda row: row["line"].startswith("|"))
    marked = F.transform(
        piped, lambda row: F.struct(row["i"].alias("i"), row["line"].alias("line"), _is_header(row["line"]).alias("h"))
    )
    split = materialize(payloads, marked=marked)
    keep = [c for c in payloads.columns if c != "body"]
    places = F.transform("marked", lambda row, place: F.when(row["h"], place))
    headed = materialize(split, starts=F.filter(places, lambda place: place.isNotNull()))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("marked")))
    # Header first: element k + 1 of ``marked`` stands at place k.
    blocks = F.zip_with("starts", ends, lambda start, end: F.slice("marked", start + 1, end - start))
    blocked = headed.select(*keep, F.explode(blocks).alias("block"))
    named = materialize(blocked, names=_names(F.get("block", F.lit(0))["line"]))
    exploded = named.select(*keep, "names", F.explode(F.slice("block", 2, F.size("block"))).alias("row"))
    return exploded.select(
        *keep,
        F.col("row.i").cast("bigint").alias("position"),
        _cells(F.col("row.line")).alias("cells"),
        "names",
    ).filter("not forall(cells, c -> c rlike '^[-: ]*$')")


def _index(names: tuple[str, ...]) -> Column:
    """Position of the first accepted name; a repeated header name means its last column."""

    def last(name: str) -> Column:
        hits = F.filter(
            F.transform("names", lambda n, i: F.when(n == name, i)), lambda i: i.isNotNull()
        )
        return F.array_max(hits)

    return F.coalesce(*[last(name) for name in names])


def table_rows(lines: DataFrame) -> DataFrame:
    """Lines that hold all required cells, with the cells named; these are the available rows."""
    located = materialize(
        lines,
        at=F.struct(
            _index(("company",)).alias("company"),
            _index(TITLE_NAMES).alias("title"),
            _index(("location",)).alias("location"),
            _index(LINK_NAMES).alias("link"),
            _index(("age",)).alias("age"),
        ),
    )
    needed = ("company", "title", "location", "link")
    complete = F.lit(True)
    for name in needed:
        complete = complete & (F.col("at")[name] < F.size("cells"))

    def cell(name: str) -> Column:
        return F.get(F.col("cells"), F.col("at")[name])

    keep = [c for c in lines.columns if c not in ("cells", "names")]
    return located.filter(complete).select(
        *keep,
        strip_markup(cell("company")).alias("company_name"),
        strip_markup(cell("title")).alias("title"),
        null_if_empty(strip_markup(cell("location"))).alias("location_text"),
        first_link(cell("link")).alias("apply_url"),
        times.age_in_days(strip_markup(cell("age"))).alias("age_days"),
    )


def markdown_gate(settings: rules.Settings, max_age_days: int | None = None) -> Column:
    """Own rows with a link, young enough and relevant; continued rows (``↳``) are dropped."""
    limit = settings.limits.max_age_days if max_age_days is None else max_age_days
    return (
        (F.col("company_name") != "")
        & (F.col("company_name") != CONTINUED)
        & (F.col("title") != "")
        & F.col("apply_url").isNotNull()
        & (F.coalesce(F.col("age_days"), F.lit(0)) <= limit)
        & listing_gate(settings.filters, F.col("source_name"))
    )


def collect_markdown(
    payloads: DataFrame, settings: rules.Settings, as_of: str, max_age_days: int | None = None
) -> DataFrame:
    """Listings of Markdown tables; payloads carry source_name, source_url, source_ordinal, body."""
    return collect_rows(table_rows(table_lines(payloads)), settings, as_of, max_age_days)


def collect_rows(
    rows: DataFrame, settings: rules.Settings, as_of: str, max_age_days: int | None = None
) -> DataFrame:
    """Listings among the rows that ``table_rows`` gives."""
    rows = rows.withColumn("description_text", F.lit(""))
    once = materialize(rows, passes=markdown_gate(settings, max_age_days))
    return select_collected(
        once.filter("passes"),
        source_type=F.lit("structured"),
        external_job_id=F.substring(F.sha2("apply_url", 256), 1, 32),
        posted_at=times.days_before(as_of, F.col("age_days")),
        confidence=F.lit(0.8),
        metadata=F.create_map(
            F.lit("format"), F.lit("github_markdown"), F.lit("age_days"), F.col("age_days").cast("string")
        ),
    )
