"""Registered queries: text, dates, identity and relevance columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions import details, relevance, text, times, urls
from feedloom.plans.testbed import (
    AS_OF,
    EXAMPLE_FAMILIES,
    FILTERS,
    AS_OF_EPOCH,
    DAY,
    LISTINGS_CTE,
    identity_cte,
    listings,
    normal_url_sql,
    normalized,
    sql_any,
    sql_list,
    sql_regex,
    table,
    wide,
)
from feedloom.sources import html, pages

QUERIES = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = (query, sql)
        return query

    return keep


@register("normalized_page_urls", f"SELECT page_id, {normal_url_sql('url')['normal']} AS normalized_url FROM pages")
def normalized_page_urls(spark, sf_dir):
    return wide(spark, sf_dir, "pages", "page_id").select("page_id", urls.normalize_url(F.col("url")).alias("normalized_url"))


@register(
    "listing_identities",
    f"WITH {LISTINGS_CTE}, {identity_cte()} "
    "SELECT doc_id, normalized_url, ats_identity, primary_identity, canonical_key FROM identified",
)
def listing_identities(spark, sf_dir):
    found = text.materialize(listings(spark, sf_dir).select("doc_id", "apply_url"), i=urls.identity_of(F.col("apply_url")))
    return found.select(
        "doc_id",
        "i.normalized_url",
        "i.ats_identity",
        "i.primary_identity",
        F.sha2("i.primary_identity", 256).alias("canonical_key"),
    )


@register(
    "title_slugs",
    "SELECT doc_id, length(slug) AS slug_length, md5(slug) AS slug_digest FROM "
    "(SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS slug FROM documents)",
)
def title_slugs(spark, sf_dir):
    docs = text.materialize(wide(spark, sf_dir, "documents", "doc_id").select("doc_id", "text"), slug=text.title_slug(F.col("text")))
    return docs.select("doc_id", F.length("slug").alias("slug_length"), F.md5("slug").alias("slug_digest"))


@register(
    "normalized_locations",
    f"WITH {LISTINGS_CTE} SELECT doc_id, trim(regexp_replace(location_text, '\\s+', ' ', 'g')) AS location_normalized, "
    f"coalesce({sql_any('lower(location_text)', rules.REMOTE_WORDS)}, FALSE) AS is_remote FROM listings",
)
def normalized_locations(spark, sf_dir):
    place = F.col("location_text")
    return listings(spark, sf_dir).select(
        "doc_id",
        text.normalized_location(place).alias("location_normalized"),
        text.is_remote(place).alias("is_remote"),
    )


@register(
    "content_hashes",
    f"WITH {LISTINGS_CTE} SELECT doc_id, "
    "sha256(CASE WHEN trim(description_text, chr(32)||chr(10)||chr(9)||chr(13)) <> '' "
    "THEN trim(description_text, chr(32)||chr(10)||chr(9)||chr(13)) ELSE title END) AS description_hash, "
    "sha256(company_name || '::' || title || '::' || coalesce(location_text, '') || '::' || "
    "trim(description_text, chr(32)||chr(10)||chr(9)||chr(13)) || '::' || apply_url) AS content_hash FROM listings",
)
def content_hashes(spark, sf_dir):
    return normalized(spark, sf_dir).select("doc_id", "description_hash", "content_hash")


_FACT_TEXT = (
    "trim(regexp_replace(title || ' ' || description_text || ' ' || coalesce(location_text, ''), '\\s+', ' ', 'g'))"
)


@register(
    "job_facts",
    f"""WITH {LISTINGS_CTE}, t AS (SELECT doc_id, {_FACT_TEXT} AS x, lower({_FACT_TEXT}) AS l,
        coalesce({sql_any('lower(location_text)', rules.REMOTE_WORDS)}, FALSE) AS remote FROM listings)
    SELECT doc_id,
        nullif(trim(regexp_extract(x, '{rules.SALARY_PATTERN}', 0, 'i')), '') AS salary,
        CASE WHEN remote OR {sql_any('l', rules.REMOTE_TEXT_WORDS)} THEN 'Remote'
             WHEN {sql_any('l', rules.HYBRID_WORDS)} THEN 'Hybrid'
             WHEN {sql_any('l', rules.ONSITE_WORDS)} THEN 'On-site' ELSE 'Not specified' END AS work_mode,
        CASE WHEN {sql_any('l', rules.NO_SPONSOR_WORDS)} THEN 'Not offered'
             WHEN {sql_any('l', rules.SPONSOR_WORDS)} THEN 'Available'
             WHEN contains(l, 'sponsor') THEN 'Check posting' ELSE 'Not specified' END AS sponsorship,
        CASE WHEN {sql_any('l', rules.CITIZEN_WORDS)} THEN 'U.S. citizenship required'
             WHEN {sql_any('l', rules.US_PERSON_WORDS)} THEN 'U.S. person requirement' ELSE 'Not specified' END AS citizenship,
        CASE WHEN {sql_any('l', rules.ACTIVE_CLEARANCE_WORDS)} THEN 'Active clearance required'
             WHEN {sql_any('l', rules.ELIGIBLE_CLEARANCE_WORDS)} THEN 'Must be eligible for clearance'
             WHEN contains(l, 'security clearance') THEN 'Check posting' ELSE 'Not specified' END AS clearance,
        array_to_string(list_sort(list_distinct(regexp_extract_all(x, '{rules.GRADUATION_PATTERN}', 1, 'i'))), ',') AS graduation_years,
        nullif(trim(regexp_extract(x, '{rules.DEADLINE_PATTERN}', 1, 'i')), '') AS application_deadline
    FROM t""",
)
def job_facts(spark, sf_dir):
    found = normalized(spark, sf_dir).select("doc_id", "job_details.*")
    return found.withColumn("graduation_years", F.array_join("graduation_years", ","))


def _item_sql(label: str, column: str) -> str:
    return f"CASE WHEN {column} <> 'Not specified' THEN '{label}: ' || {column} END"


@register(
    "detail_items",
    f"""WITH facts AS ({QUERIES['job_facts'][1]}) SELECT doc_id, array_to_string(list_filter([{_item_sql('Work mode', 'work_mode')}, {_item_sql('Salary', 'salary')},
        {_item_sql('Sponsorship', 'sponsorship')}, {_item_sql('Citizenship', 'citizenship')}, {_item_sql('Clearance', 'clearance')},
        {_item_sql('Deadline', 'application_deadline')}, CASE WHEN graduation_years <> '' THEN 'Graduation: ' || replace(graduation_years, ',', ', ') END],
        lambda v: v IS NOT NULL), ' | ') AS items FROM facts""",
)
def detail_items(spark, sf_dir):
    facts = normalized(spark, sf_dir).select("doc_id", "job_details")
    return facts.select("doc_id", F.array_join(details.detail_items(F.col("job_details")), " | ").alias("items"))


_DATE_TEXT = """CASE o_orderkey % 7
    WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
    WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T08:30:00Z'
    WHEN 2 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
    WHEN 3 THEN '17' || substr(CAST(100000000 + o_orderkey AS STRING), 2)
    WHEN 4 THEN '17' || substr(CAST(100000000 + o_orderkey AS STRING), 2) || '000'
    WHEN 5 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T10:00:00+02:00'
    ELSE 'Posted ' || CAST(o_orderkey AS STRING) || ' Days Ago' END"""


@register(
    "parsed_dates",
    f"""WITH t AS (SELECT o_orderkey, {_DATE_TEXT} AS posted, o_orderdate AS d FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 7
        WHEN 0 THEN CAST(epoch(d) AS BIGINT)
        WHEN 1 THEN CAST(epoch(d) AS BIGINT) + 30600
        WHEN 2 THEN CAST(epoch(d) AS BIGINT)
        WHEN 3 THEN CAST(posted AS BIGINT)
        WHEN 4 THEN CAST(posted AS BIGINT) // 1000
        WHEN 5 THEN CAST(epoch(d) AS BIGINT) + 28800 END AS posted_epoch FROM t""",
)
def parsed_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_DATE_TEXT} AS posted")
    return rows.select("o_orderkey", F.unix_seconds(times.parse_posted(F.col("posted"))).alias("posted_epoch"))


@register(
    "recent_entries",
    f"WITH {LISTINGS_CTE} SELECT doc_id, posted_epoch IS NULL OR posted_epoch >= {AS_OF_EPOCH} - 30 * {DAY} AS recent, "
    f"posted_epoch IS NULL OR posted_epoch >= {AS_OF_EPOCH} - 7 * {DAY} AS fresh FROM listings",
)
def recent_entries(spark, sf_dir):
    posted = F.col("posted_at")
    return listings(spark, sf_dir).select(
        "doc_id",
        times.within_days(posted, AS_OF, 30).alias("recent"),
        times.within_days(posted, AS_OF, 7).alias("fresh"),
    )


_SUMMARY_SQL = r"""WITH raw AS (
    SELECT doc_id, 'Fit ' || CAST(doc_id % 101 AS VARCHAR) || '/100 - ' || replace(text, '.', ';') AS v FROM documents),
a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(v, '[\x00-\x1f\x7f]\d?', ' ', 'g'), '\s+', ' ', 'g')) AS v FROM raw),
b AS (SELECT doc_id, regexp_replace(v, '(?i)^Fit\s+\d+/100\s*[-:]*\s*', '') AS v FROM a),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(v, ';\s*', '. ', 'g'), '\s+', ' ', 'g'), ' .-') AS v FROM b),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(v, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM c),
e AS (SELECT doc_id, array_to_string(list_transform(parts[1:2], lambda s: upper(s[1]) || s[2:]), ' ') AS v FROM d)
SELECT doc_id, CASE WHEN v = '' THEN 'No additional detail was available.'
    WHEN regexp_matches(v, '[.!?]$') THEN v ELSE v || '.' END AS summary FROM e"""


@register("readable_summaries", _SUMMARY_SQL)
def readable_summaries(spark, sf_dir):
    raw = wide(spark, sf_dir, "documents", "doc_id").selectExpr(
        "doc_id", "'Fit ' || CAST(doc_id % 101 AS STRING) || '/100 - ' || replace(text, '.', ';') AS v"
    )
    return raw.select("doc_id", text.readable_summary(F.col("v"), "Fit").alias("summary"))


_LINK = "(?i)(" + rules.FREE_TEXT_URL_PATTERN + ")"


@register(
    "links_in_documents",
    f"""WITH t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '{_LINK}', 1),
            lambda u: CASE WHEN regexp_matches(rtrim(u, '.,;:!?"'')]}}>'), '^https?://')
                THEN rtrim(u, '.,;:!?"'')]}}>') ELSE 'https://' || rtrim(u, '.,;:!?"'')]}}>') END)) AS links,
            lower(text) AS l FROM documents)
    SELECT doc_id, CAST(len(links) AS INT) AS link_count, array_to_string(list_sort(links), ' ') AS links,
           len(links) > 0 OR {sql_any('l', rules.JOB_TERMS)} AS relevant FROM t""",
)
def links_in_documents(spark, sf_dir):
    docs = text.materialize(
        wide(spark, sf_dir, "documents", "doc_id").select("doc_id", "text"), links=text.links_in_text(F.col("text"))
    )
    return docs.select(
        "doc_id",
        F.size("links").alias("link_count"),
        F.array_join(F.array_sort("links"), " ").alias("links"),
        text.mentions_job(F.col("text"), F.col("links")).alias("relevant"),
    )


@register(
    "headlines",
    f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
            lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'), ' .,:;|-')),
            lambda l: length(l) BETWEEN 8 AND 110 AND regexp_matches(l, '[A-Za-z]{{3}}')) AS lines FROM documents)
    SELECT doc_id, coalesce(list_filter(lines, lambda l: {sql_any('lower(l)', rules.JOB_TERMS)})[1], lines[1], 'New Story') AS headline FROM t""",
)
def headlines(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", text.headline(F.col("text")).alias("headline"))


def _early_sql() -> str:
    return (
        f"({sql_any('a', rules.EARLY_CAREER_WORDS)} OR {sql_any('t', rules.ENTRY_TITLE_WORDS)} "
        f"OR {sql_regex('a', rules.ENTRY_TEXT_PATTERN)})"
    )


def cohort_sql(column: str) -> str:
    bare = f"replace(replace(lower({column}), '-', ' '), '_', ' ')"
    return f"(NOT {sql_regex(bare, chr(92) + 'b20[0-9][0-9]' + chr(92) + 'b')} OR {sql_regex(bare, chr(92) + 'b2027' + chr(92) + 'b')})"


def relevant_sql(extra: str = "FALSE") -> str:
    """Role rule over ``t`` (lower title) and ``a`` (lower title and text); ``extra`` adds evidence."""
    return (
        f"(NOT {sql_any('t', rules.SUPPORT_TITLE_WORDS)} AND {cohort_sql('t')} "
        f"AND NOT {sql_any('a', rules.EXCLUDED_WORDS)} AND NOT {sql_any('t', rules.SENIOR_WORDS)} "
        f"AND NOT {sql_regex('t', rules.MID_LEVEL_TITLE_PATTERN)} AND NOT {sql_regex('t', rules.NON_ENTRY_TITLE_PATTERN)} "
        f"AND NOT {sql_regex('a', rules.EXPERIENCE_PATTERN)} "
        f"AND NOT {sql_any('a', [f.lower() for f in EXAMPLE_FAMILIES])} "
        f"AND {sql_any('t', rules.ROLE_WORDS)} AND ({_early_sql()} OR {extra}))"
    )


def folded_cte(source: str = "listings", description: str = "description_text") -> str:
    return f"folded AS (SELECT *, lower(title) AS t, lower(title || ' ' || {description}) AS a FROM {source})"


@register("relevant_roles", f"WITH {LISTINGS_CTE}, {folded_cte()} SELECT doc_id, {relevant_sql()} AS relevant FROM folded")
def relevant_roles(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "doc_id", relevance.is_relevant_role(F.col("title"), F.col("description_text"), FILTERS).alias("relevant")
    )


@register(
    "role_rejections",
    f"""WITH {LISTINGS_CTE}, {folded_cte()}, r AS (SELECT CASE WHEN {sql_any('t', rules.SUPPORT_TITLE_WORDS)} THEN 'support_title'
        WHEN NOT {cohort_sql('t')} THEN 'cohort' WHEN {sql_any('t', rules.SENIOR_WORDS)} THEN 'senior_title'
        WHEN {sql_regex('t', rules.MID_LEVEL_TITLE_PATTERN)} THEN 'mid_level_title' WHEN {sql_regex('t', rules.NON_ENTRY_TITLE_PATTERN)} THEN 'non_entry_title'
        WHEN NOT {sql_any('t', rules.ROLE_WORDS)} THEN 'no_role_in_title' WHEN {sql_any('a', rules.EXCLUDED_WORDS)} THEN 'excluded_word'
        WHEN {sql_any('a', [f.lower() for f in EXAMPLE_FAMILIES])} THEN 'excluded_family' WHEN {sql_regex('a', rules.EXPERIENCE_PATTERN)} THEN 'experience'
        WHEN NOT {_early_sql()} THEN 'no_early_career_signal' ELSE 'accepted' END AS reason FROM folded)
    SELECT reason, count(*) AS listings FROM r GROUP BY reason""",
)
def role_rejections(spark, sf_dir):
    reason = relevance.role_rejection(F.col("title"), F.col("description_text"), FILTERS)
    return (
        listings(spark, sf_dir)
        .select(F.coalesce(reason, F.lit("accepted")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("listings"))
    )


@register(
    "source_context_roles",
    f"WITH {LISTINGS_CTE}, {folded_cte()} SELECT doc_id, {relevant_sql("description_text = ''")} AS relevant FROM folded",
)
def source_context_roles(spark, sf_dir):
    context = relevance.sparse_context(F.col("description_text"), F.lit("new-grad_jobs"), F.col("source_url"))
    return listings(spark, sf_dir).select(
        "doc_id",
        relevance.is_relevant_role(F.col("title"), F.col("description_text"), FILTERS, context).alias("relevant"),
    )


@register(
    "cohort_rule",
    f"WITH {LISTINGS_CTE} SELECT doc_id, {cohort_sql(chr(40) + 'title || chr(32) || apply_url' + chr(41))} AS allowed FROM listings",
)
def cohort_rule(spark, sf_dir):
    both = F.concat_ws(" ", "title", "apply_url")
    return listings(spark, sf_dir).select("doc_id", relevance.cohort_allowed(both, FILTERS).alias("allowed"))


def _us_sql(column: str) -> str:
    folded = f"trim(replace(replace(lower({column}), '-', ' '), '_', ' '))"
    code = f"regexp_extract({column}, '{rules.US_STATE_CODE_PATTERN}', 1)"
    return (
        f"({sql_any(folded, (*rules.US_WORDS, *rules.US_STATE_NAMES))} OR {folded} IN {sql_list(rules.US_METRO_SHORTHANDS)} "
        f"OR {code} IN {sql_list(rules.US_STATE_CODES)})"
    )


def location_sql(column: str) -> str:
    low = f"lower({column})"
    return (
        f"CASE WHEN {column} IS NULL OR {column} = '' THEN TRUE "
        f"WHEN {sql_any(low, rules.NON_US_PLACES)} AND NOT {_us_sql(column)} THEN FALSE "
        f"WHEN contains({low}, 'remote') THEN TRUE WHEN {_us_sql(column)} OR trim({low}) = 'us' THEN TRUE "
        f"ELSE {sql_any(low, ['united states', 'remote'])} END"
    )


@register(
    "location_rule",
    f"WITH {LISTINGS_CTE} SELECT doc_id, {_us_sql('coalesce(location_text, chr(32))')} AS us, "
    f"{sql_any('lower(coalesce(location_text, chr(32)))', rules.NON_US_PLACES)} AS non_us, "
    f"{location_sql('location_text')} AS allowed FROM listings",
)
def location_rule(spark, sf_dir):
    place = F.col("location_text")
    return listings(spark, sf_dir).select(
        "doc_id",
        F.coalesce(relevance.us_signal(place), F.lit(False)).alias("us"),
        F.coalesce(relevance.non_us_signal(place), F.lit(False)).alias("non_us"),
        relevance.location_allowed(place, FILTERS).alias("allowed"),
    )


HINTS = ("tion", "heit", "de la", "the ")


@register(
    "hint_matches",
    "SELECT lang, count(*) AS documents, count(*) FILTER ("
    + sql_any("trim(replace(replace(lower(text), '-', ' '), '_', ' '))", HINTS)
    + ") AS with_hint FROM documents GROUP BY lang",
)
def hint_matches(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents", "doc_id")
    hit = text.bind(text.fold_hint(F.col("text")), lambda low: text.any_word(low, HINTS))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(hit).alias("with_hint"))


BLOCKED = ("example.org", "example.net")


@register(
    "direct_pages",
    "SELECT page_id, url FROM pages WHERE NOT regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), "
    "'^www\\.', ''), '(^|\\.)(example\\.org|example\\.net)$')",
)
def direct_pages(spark, sf_dir):
    return wide(spark, sf_dir, "pages", "page_id").filter(~urls.on_domain(F.col("url"), BLOCKED)).select("page_id", "url")


@register(
    "resolved_page_links",
    "WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) "
    "SELECT page_id, count(*) AS links, count(DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href) AS distinct_links, "
    "min(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href) AS first_link FROM h GROUP BY page_id",
)
def resolved_page_links(spark, sf_dir):
    rows = wide(spark, sf_dir, "pages", "page_id").select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")
    )
    links = text.materialize(rows, link=urls.resolve_link(F.col("url"), F.col("href")))
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_distinct("link").alias("distinct_links"),
        F.min("link").alias("first_link"),
    )


@register(
    "careers_urls",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://' || lower(replace(s_name, '#', '-')) || '.example/work' "
    "ELSE 'https://' || lower(replace(s_name, '#', '-')) || '.example/careers' END AS careers_url FROM supplier",
)
def careers_urls(spark, sf_dir):
    home = F.concat(F.lit("https://"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example"))
    configured = F.when(F.col("s_suppkey") % 2 == 0, F.concat(home, F.lit("/work")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", urls.careers_url(configured, home).alias("careers_url"))


_SPLIT = {
    "Associate Software Engineer (Remote, US)": ("Associate Software Engineer", "Remote, US"),
    "Product Engineer, New Graduate - Austin, TX": ("Product Engineer, New Graduate", "Austin, TX"),
    "Software Developer | Early Career | Seattle": ("Software Developer | Early Career", "Seattle"),
}


@register(
    "split_titles",
    f"WITH {LISTINGS_CTE} SELECT doc_id, CASE title "
    + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _SPLIT.items())
    + " ELSE title END AS role, CASE title "
    + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _SPLIT.items())
    + " END AS place FROM listings",
)
def split_titles(spark, sf_dir):
    rows = text.materialize(
        listings(spark, sf_dir).select("doc_id", "title"), s=pages.split_title(F.col("title"))
    )
    return rows.select("doc_id", F.col("s.title").alias("role"), F.col("s.location").alias("place"))


_BREAK = "chr(1)"
_BARE_HTML = (
    f"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', {_BREAK}, 'g'), '<[^>]*>', {_BREAK}, 'g')"
)


@register(
    "page_texts",
    f"""WITH u AS (SELECT page_id, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS html FROM pages),
    t AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split({_BARE_HTML}, {_BREAK}), lambda p: trim(p, chr(32)||chr(10)||chr(9)||chr(13))),
        lambda p: p <> ''), ' ') AS x FROM u)
    SELECT page_id, CAST(length(x) AS INT) AS characters, sha256(x) AS digest FROM t""",
)
def page_texts(spark, sf_dir):
    docs = wide(spark, sf_dir, "pages", "page_id").select("page_id", html.html_to_text("html").alias("text"))
    return docs.select("page_id", F.length("text").alias("characters"), F.sha2("text", 256).alias("digest"))
