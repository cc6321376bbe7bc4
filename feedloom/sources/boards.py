"""Job-board payloads of six platforms, mapped in one scan of the landing table.

A platform is an entry of ``PLATFORMS``: how to find its postings in a payload, when the payload
counts as failed, and how one posting becomes named fields. New platforms are added the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions import times
from feedloom.functions.text import bind, materialize, null_if_empty
from feedloom.schemas import select_collected
from feedloom.sources.gates import listing_gate

FIELDS = ("apply_url", "title", "external_job_id", "location_text", "posted", "description_text", "employment_type")


@dataclass(frozen=True)
class Platform:
    """Payload mapper of one platform."""

    payload_ddl: str
    items: Callable[[Column], Column]
    failure: Callable[[Column], Column]
    item_ddl: str
    fields: Callable[[Column], dict[str, Column]]
    list_payload: bool = False


def _first(*texts: Column) -> Column:
    return F.coalesce(*[null_if_empty(t) for t in texts])


def _no_failure(_: Column) -> Column:
    return F.lit(None).cast("string")


def _has_errors(payload: Column) -> Column:
    return F.when(
        ~F.coalesce(payload["errors"], F.lit("")).isin("", "[]", "{}", "false", "0"),
        F.concat(F.lit("board returned an error: "), payload["errors"]),
    )


def _greenhouse(item: Column) -> dict[str, Column]:
    return {
        "apply_url": _first(item["absolute_url"], item["url"], F.col("careers_url"), F.col("api_url")),
        "title": item["title"],
        "external_job_id": item["id"],
        "location_text": item["location"]["name"],
        "posted": item["updated_at"],
        "description_text": item["content"],
    }


def _lever(item: Column) -> dict[str, Column]:
    return {
        "apply_url": _first(item["hostedUrl"], item["applyUrl"], F.col("careers_url"), F.col("api_url")),
        "title": item["text"],
        "external_job_id": item["id"],
        "location_text": item["categories"]["location"],
        "posted": item["createdAt"],
        "description_text": _first(item["descriptionPlain"], item["description"]),
    }


def _ashby(item: Column) -> dict[str, Column]:
    return {
        "apply_url": _first(item["applyUrl"], item["jobUrl"], F.col("careers_url")),
        "title": item["title"],
        "external_job_id": item["id"],
        "location_text": _first(item["locationName"], item["location"]),
        "posted": _first(item["publishedDate"], item["publishedAt"]),
        "description_text": item["descriptionHtml"],
        "employment_type": item["employmentType"],
    }


def _ashby_failure(payload: Column) -> Column:
    return F.coalesce(
        _has_errors(payload),
        F.when(payload["jobs"].isNull() & payload["data"]["jobsBoard"]["jobs"].isNull(), "response is missing jobs"),
        # Only a list of postings counts; objects start with a brace.
        F.when(
            F.exists(_ashby_items(payload), lambda raw: raw.isNull() | ~F.ltrim(raw).startswith("{")),
            "jobs must be a list of postings",
        ),
    )


def _ashby_items(payload: Column) -> Column:
    return F.coalesce(payload["jobs"], payload["data"]["jobsBoard"]["jobs"])


def _smartrecruiters(item: Column) -> dict[str, Column]:
    place = item["location"]
    return {
        "apply_url": _first(item["ref"], F.col("careers_url"), F.col("api_url")),
        "title": item["name"],
        "external_job_id": item["id"],
        "location_text": null_if_empty(
            F.concat_ws(", ", null_if_empty(place["city"]), null_if_empty(place["region"]))
        ),
        "posted": item["releasedDate"],
        "description_text": item["jobAd"]["sections"]["jobDescription"]["text"],
    }


def _workday(item: Column) -> dict[str, Column]:
    bullets = item["bulletFields"]
    return {
        "apply_url": _first(item["externalPath"], item["applyUrl"], F.col("careers_url"), F.col("api_url")),
        "title": _first(item["title"], F.get(bullets, F.lit(0))),
        "external_job_id": _first(F.get(bullets, F.lit(1)), item["id"]),
        "location_text": _first(item["locationsText"], item["location"]),
        "posted": _first(item["postedOn"], item["postedDate"]),
        "description_text": item["description"],
    }


def _gem(item: Column) -> dict[str, Column]:
    external = _first(item["extId"], item["id"])
    return {
        "apply_url": F.concat(
            F.lit("https://jobs.gem.com/"), F.col("identifier"), F.lit("/"), F.coalesce(external, F.lit(""))
        ),
        "title": item["title"],
        "external_job_id": external,
        "location_text": gem_location(item["locations"], item["job"]["locationType"]),
        "posted": F.lit(None).cast("string"),
        "description_text": F.lit(""),
        "employment_type": item["job"]["employmentType"],
    }


def gem_location(places: Column, location_type: Column) -> Column:
    """Distinct place names in order, led by ``Remote`` when only the type says so."""
    names = F.array_distinct(
        F.filter(
            F.transform(places, lambda p: F.trim(F.coalesce(_first(p["name"], p["city"]), F.lit("")))),
            lambda name: name != "",
        )
    )

    def text(found: Column) -> Column:
        unsaid = (F.upper(F.coalesce(location_type, F.lit(""))) == "REMOTE") & ~F.exists(
            found, lambda name: F.lower(name).contains("remote")
        )
        return null_if_empty(
            F.array_join(F.when(unsaid, F.concat(F.array(F.lit("Remote")), found)).otherwise(found), ", ")
        )

    return bind(F.coalesce(names, F.expr("cast(array() as array<string>)")), text)


PLATFORMS: dict[str, Platform] = {
    "ashby": Platform(
        "jobs array<string>, data struct<jobsBoard: struct<jobs: array<string>>>, errors string",
        _ashby_items,
        _ashby_failure,
        "id string, title string, applyUrl string, jobUrl string, locationName string, location string, "
        "publishedDate string, publishedAt string, descriptionHtml string, employmentType string",
        _ashby,
    ),
    "gem": Platform(
        "data struct<oatsExternalJobPostings: struct<jobPostings: array<string>>>, errors string",
        lambda p: p["data"]["oatsExternalJobPostings"]["jobPostings"],
        _has_errors,
        "id string, extId string, title string, locations array<struct<name: string, city: string>>, "
        "job struct<locationType: string, employmentType: string>",
        _gem,
    ),
    "greenhouse": Platform(
        "jobs array<string>",
        lambda p: p["jobs"],
        _no_failure,
        "id string, title string, absolute_url string, url string, updated_at string, "
        "location struct<name: string>, content string",
        _greenhouse,
    ),
    "lever": Platform(
        "array<string>",
        lambda p: p,
        _no_failure,
        "id string, text string, hostedUrl string, applyUrl string, createdAt string, "
        "descriptionPlain string, description string, categories struct<location: string>",
        _lever,
        list_payload=True,
    ),
    "smartrecruiters": Platform(
        "content array<string>",
        lambda p: p["content"],
        _no_failure,
        "id string, name string, ref string, releasedDate string, location struct<city: string, region: string>, "
        "jobAd struct<sections: struct<jobDescription: struct<text: string>>>",
        _smartrecruiters,
    ),
    "workday": Platform(
        "jobPostings array<string>, jobs array<string>, data array<string>",
        lambda p: F.coalesce(p["jobPostings"], p["jobs"], p["data"]),
        _no_failure,
        "id string, title string, bulletFields array<string>, locationsText string, location string, "
        "postedOn string, postedDate string, externalPath string, applyUrl string, description string",
        _workday,
    ),
}

_CORRUPT = "_unreadable"


def _is_platform(name: str) -> Column:
    return F.lower(F.col("platform")) == name


def _payload_reader(spec: Platform) -> Callable[[Column], Column]:
    def read(payload: Column) -> Column:
        unreadable = payload[_CORRUPT].isNotNull() | F.col("body").isNull()
        failure = F.when(unreadable, "payload is not readable").otherwise(spec.failure(payload))
        return F.struct(spec.items(payload).alias("items"), failure.alias("failure"))

    return read


def _item_reader(spec: Platform) -> Callable[[Column], Column]:
    def read(item: Column) -> Column:
        named = spec.fields(item)
        return F.struct(*[named.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])

    return read


def board_items(payloads: DataFrame, platforms: dict[str, Platform] = PLATFORMS) -> DataFrame:
    """Per payload: ``items`` (raw postings), ``failure`` (text or null) and ``supported``.

    Payloads carry source_ordinal, platform, company_name, identifier, api_url, careers_url,
    fetched_at and body. An unreadable body fails its own source and no other.
    """
    items, failure = None, None
    body = F.col("body")
    for name, spec in platforms.items():
        if spec.list_payload:
            parsed = F.from_json(body, spec.payload_ddl)
            found = F.struct(
                parsed.alias("items"),
                F.when(~F.coalesce(F.ltrim(body), F.lit("")).startswith("[") | parsed.isNull(), "payload is not a list")
                .alias("failure"),
            )
        else:
            parsed = F.from_json(
                body, f"{spec.payload_ddl}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT}
            )
            found = bind(parsed, _payload_reader(spec))
        condition = _is_platform(name)
        if name == "workday":
            # A board without its own API address yields nothing and is healthy.
            empty = F.struct(F.expr("cast(array() as array<string>)").alias("items"), _no_failure(body).alias("failure"))
            found = F.when(F.coalesce(F.col("api_url"), F.lit("")) == "", empty).otherwise(found)
        items = F.when(condition, found) if items is None else items.when(condition, found)
    keep = [c for c in payloads.columns if c != "body"]
    found = materialize(payloads, board=items)
    ok = F.col("board.failure").isNull()
    return found.select(
        *keep,
        F.lower(F.col("platform")).isin(*platforms).alias("supported"),
        F.col("board.failure").alias("failure"),
        F.when(ok, F.coalesce(F.col("board.items"), F.expr("cast(array() as array<string>)"))).alias("items"),
    )


def board_postings(found: DataFrame, platforms: dict[str, Platform] = PLATFORMS) -> DataFrame:
    """One row per posting in named fields; payloads without postings keep one row, position null."""
    keep = [c for c in found.columns if c != "items"]
    rows = found.select(*keep, F.posexplode_outer("items").alias("position", "raw"))
    mapped = None
    for name, spec in platforms.items():
        value = bind(F.from_json(F.col("raw"), spec.item_ddl), _item_reader(spec))
        mapped = F.when(_is_platform(name), value) if mapped is None else mapped.when(_is_platform(name), value)
    named = materialize(rows, job=mapped)
    return named.select(
        *[c for c in rows.columns if c != "raw"],
        F.concat_ws(":", "platform", "company_name").alias("source_name"),
        F.coalesce(F.col("job.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("job.apply_url"), F.lit("")).alias("apply_url"),
        null_if_empty(F.col("job.external_job_id")).alias("external_job_id"),
        F.col("job.location_text").alias("location_text"),
        times.parse_posted(F.col("job.posted")).alias("posted_at"),
        F.coalesce(F.col("job.description_text"), F.lit("")).alias("description_text"),
        F.col("job.employment_type").alias("employment_type"),
    )


def judged_postings(payloads: DataFrame, filters: rules.Filters) -> DataFrame:
    """Postings with the gate result; feeds both the listings and the source outcome."""
    rows = board_postings(board_items(payloads))
    return materialize(rows, passes=F.col("position").isNotNull() & listing_gate(filters))


def collect_boards(judged: DataFrame) -> DataFrame:
    source_url = F.when(
        F.lower("platform") == "gem", F.coalesce(null_if_empty(F.col("careers_url")), F.col("api_url"))
    ).otherwise(F.col("api_url"))
    return select_collected(
        judged.filter("passes"),
        source_type=F.lit("ats"),
        source_url=source_url,
        metadata=F.create_map(F.lit("ats_platform"), F.lower("platform")),
    )
