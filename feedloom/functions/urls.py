"""URL columns: parts, normal form, requisition identity, hosts and relative links."""

from __future__ import annotations

from collections.abc import Iterable
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.text import any_word, bind, null_if_empty, strip, title_case, word_array

# scheme, authority, path and query of RFC 3986; never throws, unlike parse_url under ANSI mode.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def authority_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 2))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def host_of(url: Column) -> Column:
    """Lower-case authority without a leading ``www.``."""
    return F.regexp_replace(authority_of(url), r"^www\.", "")


def _decode(part: Column) -> Column:
    # A malformed escape stays as it is; plus signs are spaces either way.
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encode(part: Column) -> Column:
    escaped = F.url_encode(part)
    return F.replace(F.replace(escaped, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query_pairs(query: Column) -> Column:
    """Sorted ``(k, v)`` pairs of a query without tracking keys."""

    def pair(piece: Column) -> Column:
        value = F.when(piece.contains("="), F.substr(piece, F.instr(piece, "=") + 1)).otherwise(F.lit(""))
        return F.struct(_decode(F.substring_index(piece, "=", 1)).alias("k"), _decode(value).alias("v"))

    def wanted(item: Column) -> Column:
        key = F.lower(item["k"])
        return ~F.array_contains(word_array(rules.TRACKING_KEYS), key) & ~key.startswith(rules.TRACKING_PREFIX)

    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")
    return F.array_sort(F.filter(F.transform(pieces, pair), wanted))


def url_parts(url: Column) -> Column:
    """Struct of the normal form: scheme, host, path and sorted query pairs."""

    def parts(bare: Column) -> Column:
        scheme = scheme_of(bare)
        path = F.regexp_replace(path_of(bare), "/+$", "")
        query = F.regexp_extract(bare, _SPLIT, 4)
        return F.struct(
            F.when(scheme == "http", F.lit("https")).otherwise(scheme).alias("scheme"),
            host_of(bare).alias("host"),
            F.regexp_replace(path, "(?i)/(?:application|apply)/?$", "").alias("path"),
            F.when(query != "", _query_pairs(query)).alias("pairs"),
        )

    return bind(strip(url), parts)


def _assemble(parts: Column) -> Column:
    joined = F.array_join(
        F.transform(parts["pairs"], lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )
    prefix = F.when(
        parts["host"] != "",
        F.concat(
            F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":"))).otherwise(F.lit("")),
            F.lit("//"),
            parts["host"],
            # An authority and a path are always parted by a slash.
            F.when((parts["path"] != "") & ~parts["path"].startswith("/"), F.lit("/")).otherwise(F.lit("")),
        ),
    ).otherwise(F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":"))).otherwise(F.lit("")))
    query = F.when(F.coalesce(F.size(parts["pairs"]), F.lit(0)) > 0, F.concat(F.lit("?"), joined))
    return F.concat(prefix, parts["path"], F.coalesce(query, F.lit("")))


def normalize_url(url: Column) -> Column:
    """https, no ``www.``, no trailing slash, apply suffix, tracking keys or fragment."""
    return bind(url_parts(url), _assemble)


def _requisition(parts: Column) -> Column:
    host, path = parts["host"], parts["path"]

    def query_value(name: str) -> Column:
        # Pairs are sorted, so the last one is the one a plain dictionary would keep.
        found = F.filter(parts["pairs"], lambda p: (p["k"] == name) & (p["v"] != ""))
        return F.try_element_at(found, F.lit(-1))["v"]

    def from_path(pattern: str, group: int = 1) -> Column:
        return null_if_empty(F.regexp_extract(path, "(?i)" + pattern, group))

    def org_and_uuid(platform: str) -> Column:
        pattern = f"/([^/]+)/({_UUID})(?:/|$)"
        return F.concat(
            F.lit(platform + "::"),
            F.lower(from_path(pattern, 1)),
            F.lit("::"),
            F.lower(from_path(pattern, 2)),
        )

    by_query = F.coalesce(query_value("gh_jid"), query_value("token"))
    return F.coalesce(
        F.when(by_query.rlike("^[0-9]+$"), F.concat(F.lit("greenhouse::"), by_query)),
        F.when(host.contains("ashbyhq.com"), org_and_uuid("ashby")),
        F.when(host.contains("lever.co"), org_and_uuid("lever")),
        F.when(
            host.contains("greenhouse"),
            F.concat(F.lit("greenhouse::"), from_path(r"/jobs/(\d+)(?:/|$)")),
        ),
        F.when(
            host.contains("myworkdayjobs.com"),
            F.concat(F.lit("workday::"), host, F.lit("::"), F.lower(from_path("_((?:JR|R)[A-Z0-9-]+)$"))),
        ),
        F.when(
            host.contains("icims.com"),
            F.concat(F.lit("icims::"), host, F.lit("::"), from_path(r"/jobs/(\d+)(?:/|$)")),
        ),
    )


def ats_identity(url: Column) -> Column:
    """Requisition identity that does not depend on the feed, or null."""
    return bind(url_parts(url), _requisition)


def identity_of(url: Column) -> Column:
    """Struct (normalized_url, ats, primary_identity) from one pass over the URL."""

    def build(parts: Column) -> Column:
        return F.struct(_assemble(parts).alias("normalized_url"), _requisition(parts).alias("ats"))

    def primary(found: Column) -> Column:
        return F.struct(
            found["normalized_url"].alias("normalized_url"),
            found["ats"].alias("ats_identity"),
            F.coalesce(
                F.concat(F.lit("ats::"), found["ats"]), F.concat(F.lit("url::"), found["normalized_url"])
            ).alias("primary_identity"),
        )

    return bind(bind(url_parts(url), build), primary)


def canonical_key(url: Column) -> Column:
    return F.sha2(identity_of(url)["primary_identity"], 256)


def on_domain(url: Column, domains: Iterable[str]) -> Column:
    """True when the host is one of the domains or below one."""
    names = "|".join(d.replace(".", r"\.") for d in domains)
    return host_of(url).rlike(rf"(^|\.)(?:{names})$")


def looks_like_job_link(href: Column) -> Column:
    return bind(F.lower(href), lambda low: any_word(low, (*rules.BOARD_LINK_HOSTS, *rules.JOB_LINK_PATHS)))


def resolve_link(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page; dot segments are folded."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    base_path = path_of(base)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, _fold_dots(link)))
        .when(link == "", base)
        .when(link.startswith("?"), F.concat(root, base_path, link))
        .when(link.startswith("#"), F.concat(F.substring_index(base, "#", 1), link))
        .otherwise(F.concat(root, _fold_dots(F.concat(folder, link))))
    )
    return joined


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path, query untouched."""
    bare = F.regexp_extract(path, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(path, r"(?s)^[^?#]*(.*)$", 1)
    # The path is absolute, so the piece before its first slash is empty.
    segments = F.filter(F.split(bare, "/"), lambda _, i: i > 0)

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", shorter)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
    # A path that ends in a dot segment names a folder.
    tail = F.when(bare.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    folded = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^/{2,}$", "/")
    return F.when(bare.rlike(r"/\.\.?(/|$)"), F.concat(folded, rest)).otherwise(path)


def careers_url(careers: Column, homepage: Column) -> Column:
    """Configured careers page, else ``/careers`` on the homepage."""
    return F.coalesce(null_if_empty(careers), resolve_link(homepage, F.lit("/careers")))


def company_from_url(url: Column) -> Column:
    """Company named by the path of a hosted job board, or null on other hosts."""

    def name(host_and_path: Column) -> Column:
        host, parts = host_and_path["host"], host_and_path["parts"]
        after_boards = F.get(parts, F.array_position(parts, F.lit("boards")).cast("int"))
        slug = (
            F.when(host.contains("jobs.ashbyhq.com") | host.contains("jobs.lever.co"), F.get(parts, F.lit(0)))
            .when(
                host.contains("greenhouse.io"),
                F.when(F.array_contains(parts, F.lit("boards")), F.coalesce(after_boards, F.get(parts, F.lit(0))))
                .otherwise(F.get(parts, F.lit(0))),
            )
            .when(host.contains("smartrecruiters.com"), F.get(parts, F.lit(0)))
        )
        return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))

    return bind(
        F.struct(
            authority_of(url).alias("host"),
            F.filter(F.split(path_of(url), "/"), lambda part: part != "").alias("parts"),
        ),
        name,
    )
