"""Company and job pages: JSON-LD postings, anchors, embedded board links, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions import times
from feedloom.functions.relevance import is_relevant_role, location_allowed
from feedloom.functions.text import any_word, bind, collapse, materialize, null_if_empty, strip_chars
from feedloom.functions.urls import looks_like_job_link, resolve_link
from feedloom.schemas import select_collected

_SEPARATOR = r" [|—–-] "


def looks_like_place(text: Column) -> Column:
    """A known place word, or a list with commas or semicolons."""
    low_hit = bind(F.lower(text), lambda low: any_word(low, rules.TITLE_PLACE_WORDS))
    return (F.trim(text) != "") & (low_hit | text.contains(";") | text.contains(","))


def split_title(title: Column) -> Column:
    """Struct (title, location): place taken from the end of a title.

    Tried in order: trailing parentheses, the last separator before a place, text after a marker.
    """

    def result(head: Column, place: Column) -> Column:
        return F.struct(head.alias("title"), place.alias("location"))

    def rstrip(text: Column) -> Column:
        return strip_chars(text, " -|,", left=False)

    def by_parentheses(text: Column) -> Column:
        inner = F.regexp_extract(text, r"\(([^()]+)\)\s*$", 1)
        head = F.regexp_replace(text, r"\([^()]+\)\s*$", "")
        return F.when(looks_like_place(inner), result(rstrip(head), F.trim(inner)))

    def by_separator(text: Column) -> Column:
        pieces = F.split(text, _SEPARATOR)
        # A separator is three characters long, so piece lengths give its offset.
        offsets = F.aggregate(
            F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
            F.expr("cast(array(0) as array<int>)"),
            lambda ends, piece: F.concat(
                ends, F.array(F.try_element_at(ends, F.lit(-1)) + F.length(piece) + 3)
            ),
        )
        cuts = F.filter(offsets, lambda _, i: i > 0)
        placed = F.filter(cuts, lambda end: looks_like_place(F.substr(text, end + 1)))
        end = F.try_element_at(placed, F.lit(-1))
        return F.when(
            end.isNotNull(),
            result(rstrip(F.substr(text, F.lit(1), end - 3)), F.trim(F.substr(text, end + 1))),
        )

    def by_marker(text: Column) -> Column:
        def one(marker: str) -> Column:
            start = F.instr(F.lower(text), marker)
            end = start + len(marker) - 1
            place = strip_chars(F.substr(text, end + 1), " ,;-")
            return F.when(
                (start > 0) & looks_like_place(place), result(rstrip(F.substr(text, F.lit(1), end)), place)
            )

        return F.coalesce(*[one(m) for m in rules.TITLE_SPLIT_MARKERS])

    def split(text: Column) -> Column:
        plain = result(text, F.lit(None).cast("string"))
        return F.coalesce(by_parentheses(text), by_separator(text), by_marker(text), plain)

    return bind(collapse(title), split)


def posting_gate(posting: Column, company: Column, filters: rules.Filters) -> Column:
    """A title, a company, an allowed place and a relevant role."""
    return (
        posting["title"].isNotNull()
        & (F.coalesce(company, F.lit("")) != "")
        & location_allowed(posting["location"], filters)
        & is_relevant_role(posting["title"], posting["description"], filters)
    )


def _employer(posting: Column) -> Column:
    return F.when(posting["has_organization"], posting["organization"]).otherwise(F.col("company_name"))


def posting_listings(facts: DataFrame, filters: rules.Filters) -> DataFrame:
    """JSON-LD postings that pass the gate, with all page columns kept.

    ``facts`` carries url (the page), source_name, source_type, source_ordinal and company_name
    (the company known beforehand, or null).
    """
    rows = facts.select(
        *[c for c in facts.columns if c not in ("postings", "anchors", "descriptions")],
        F.posexplode("postings").alias("position", "posting"),
    )
    posting = F.col("posting")
    once = materialize(rows, passes=posting_gate(posting, _employer(posting), filters))
    return once.filter("passes").withColumns(
        {
            "company_name": _employer(posting),
            "title": posting["title"],
            "description_text": posting["description"],
            "location_text": posting["location"],
            "apply_url": resolve_link(F.col("url"), F.coalesce(posting["url"], F.col("url"))),
            "external_job_id": posting["identifier"],
            "posted_at": times.parse_posted(posting["date_posted"]),
            "employment_type": posting["employment_type"],
            "confidence": F.lit(1.0),
            "metadata": F.create_map(F.lit("parser"), F.lit("json_ld")),
        }
    )


def anchor_gate(title: Column, location: Column, href: Column, filters: rules.Filters) -> Column:
    """Link looks like a job, title short enough, place allowed or an early-career word in the title."""
    placed = F.when(F.coalesce(location, F.lit("")) != "", location_allowed(location, filters)).otherwise(
        bind(F.lower(title), lambda low: any_word(low, rules.ANCHOR_MARKERS))
    )
    return (
        (title != "")
        & looks_like_job_link(href)
        & (F.length(title) <= 140)
        & placed
        & is_relevant_role(title, F.lit(""), filters)
    )


def anchor_rows(facts: DataFrame) -> DataFrame:
    """One row per non-empty anchor with its title split."""
    rows = facts.select(
        *[c for c in facts.columns if c not in ("postings", "anchors", "descriptions")],
        F.posexplode("anchors").alias("position", "anchor"),
    ).filter(F.col("anchor.text") != "")
    return materialize(rows, split=split_title(F.col("anchor.text")))


def anchor_listings(facts: DataFrame, filters: rules.Filters) -> DataFrame:
    """Anchors that pass as listings; the caller decides which pages may use them."""
    rows = anchor_rows(facts)
    once = materialize(
        rows,
        passes=anchor_gate(F.col("split.title"), F.col("split.location"), F.col("anchor.href"), filters),
    )
    return once.filter("passes").withColumns(
        {
            "title": F.col("split.title"),
            "location_text": F.col("split.location"),
            "description_text": F.lit(""),
            "apply_url": resolve_link(F.col("url"), F.col("anchor.href")),
            "company_name": F.coalesce(
                null_if_empty(F.col("company_name")), F.col("page_title"), F.lit("Unknown Company")
            ),
            "confidence": F.lit(0.6),
            "metadata": F.create_map(
                F.lit("parser"), F.lit("anchor_fallback"), F.lit("raw_anchor_text"), F.col("anchor.text")
            ),
        }
    )


def _passed(filters: rules.Filters) -> Column:
    """The postings of a page that pass the gate, each with its place on the page."""
    placed = F.transform("postings", lambda posting, i: F.struct(i.alias("place"), posting.alias("posting")))
    return F.filter(placed, lambda x: posting_gate(x["posting"], _employer(x["posting"]), filters))


def _passed_anchors(filters: rules.Filters) -> Column:
    named = F.filter(
        F.transform("anchors", lambda anchor, i: F.struct(i.alias("place"), anchor.alias("anchor"))),
        lambda x: x["anchor"]["text"] != "",
    )
    split = F.transform(
        named, lambda x: F.struct(x["place"].alias("place"), x["anchor"].alias("anchor"), split_title(x["anchor"]["text"]).alias("split"))
    )
    return F.filter(
        split, lambda x: anchor_gate(x["split"]["title"], x["split"]["location"], x["anchor"]["href"], filters)
    )


def page_listings(facts: DataFrame, filters: rules.Filters, fallback: Column, page_key: str = "page_id") -> DataFrame:
    """Postings of every page; anchors only where a page gave none and ``fallback`` holds.

    Both are decided within the row of the page: its postings pass the gate once, and its anchors are looked at
    only if none did.
    """
    once = materialize(facts, passed=_passed(filters))
    wanted = F.when((F.size("passed") == 0) & fallback, _passed_anchors(filters))

    def entry(x: Column, is_posting: bool) -> Column:
        posting, anchor = (x["posting"], None) if is_posting else (None, x["anchor"])
        none = F.lit(None).cast("string")
        parser = F.create_map(F.lit("parser"), F.lit("json_ld")) if is_posting else F.create_map(
            F.lit("parser"), F.lit("anchor_fallback"), F.lit("raw_anchor_text"), anchor["text"]
        )
        unknown = F.coalesce(null_if_empty(F.col("company_name")), F.col("page_title"), F.lit("Unknown Company"))
        href = F.coalesce(posting["url"], F.col("url")) if is_posting else anchor["href"]
        return F.struct(
            x["place"].cast("bigint").alias("position"),
            (_employer(posting) if is_posting else unknown).alias("company_name"),
            (posting["title"] if is_posting else x["split"]["title"]).alias("title"),
            (posting["location"] if is_posting else x["split"]["location"]).alias("location_text"),
            (posting["description"] if is_posting else F.lit("")).alias("description_text"),
            href.alias("href"),
            (posting["identifier"] if is_posting else none).alias("external_job_id"),
            (posting["date_posted"] if is_posting else none).alias("date_posted"),
            (posting["employment_type"] if is_posting else none).alias("employment_type"),
            F.lit(1.0 if is_posting else 0.6).alias("confidence"),
            parser.alias("metadata"),
        )

    postings = F.transform("passed", lambda x: entry(x, True))
    anchors = F.transform(wanted, lambda x: entry(x, False))
    listed = F.concat(postings, F.coalesce(anchors, F.array().cast(_entry_type(once, postings))))
    known = [c for c in ("url", "source_name", "source_type", "source_ordinal", "fetched_at") if c in facts.columns]
    rows = once.select(*known, F.explode(listed).alias("e"))
    return select_collected(
        rows.select(*known, "e.*"),
        source_url=F.col("url"),
        apply_url=resolve_link(F.col("url"), F.col("href")),
        posted_at=times.parse_posted(F.col("date_posted")),
    )


def _entry_type(rows: DataFrame, entries: Column) -> str:
    return rows.select(entries.alias("e")).schema["e"].dataType.simpleString()


def fallback_listings(facts: DataFrame, filters: rules.Filters, fallback: Column, page_key: str = "page_id") -> DataFrame:
    """Anchor listings of the pages without a posting that passes, where ``fallback`` holds."""
    once = materialize(facts, passed=F.size(_passed(filters)))
    return anchor_listings(once.filter(fallback & (F.col("passed") == 0)).drop("passed"), filters)


def _links_of(platform: str, pattern: str) -> Column:
    return F.transform(
        F.regexp_extract_all("html", F.lit("(?i)" + pattern), F.lit(1)),
        lambda name, i: F.struct(F.lit(platform).alias("platform"), name.alias("identifier"), i.alias("place")),
    )


def discovered_boards(pages: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Board links in page source: distinct per (page, platform, identifier), first spelling kept."""
    found = [_links_of(platform, pattern) for platform, pattern in rules.BOARD_LINK_PATTERNS.items()]
    links = pages.select(page_key, F.explode(F.concat(*found)).alias("link"))
    return links.groupBy(
        page_key, F.col("link.platform").alias("platform"), F.lower("link.identifier").alias("board_key")
    ).agg(F.min_by("link.identifier", "link.place").alias("identifier"), F.min("link.place").alias("place"))


def scan_list(companies: DataFrame, priority: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """The companies whose pages are read in a run: priority names first, then tier, then name.

    All of them, in no order, without a limit.
    """
    name = F.lower(F.coalesce(F.col("name"), F.lit("")))
    is_priority = name.isin(*[p.lower() for p in priority]) if priority else F.lit(False)
    enabled = companies.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    if limit is None:
        return enabled
    return (
        enabled.orderBy(
            F.when(is_priority, 0).otherwise(1),
            F.coalesce(F.col("priority_tier"), F.lit(3)),
            name,
            "slug",
        )
        .limit(limit)
    )


def company_listings(
    facts: DataFrame, board_jobs: DataFrame, filters: rules.Filters, page_key: str = "page_id"
) -> DataFrame:
    """Jobs of boards found on a page replace the page's own listings.

    ``facts`` carries priority_tier; ``board_jobs`` carries the page key and the collected layout.
    """
    with_boards = board_jobs.select(page_key).distinct()
    rest = facts.join(with_boards, page_key, "left_anti")
    own = page_listings(rest, filters, F.coalesce(F.col("priority_tier"), F.lit(3)) <= 1, page_key)
    return select_collected(board_jobs).unionByName(own)


def best_description(facts: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Longest candidate text of every page, the earlier one on a tie; empty without a candidate."""
    longest = F.aggregate(
        "descriptions",
        F.lit(""),
        lambda best, text: F.when(F.length(text) > F.length(best), text).otherwise(best),
    )
    return facts.select(page_key, "url", longest.alias("description"))
