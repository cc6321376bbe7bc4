"""Registered queries: sources. Payloads are built from the given tables, forty listings each."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules
from feedloom.operators import enrichment
from feedloom.operators.dedupe import merge_duplicates
from feedloom.operators.normalize import normalize
from feedloom.plans.testbed import (
    AS_OF,
    FILTERS,
    AS_OF_EPOCH,
    DAY,
    LISTINGS_CTE,
    PLACES,
    TITLES,
    choose,
    collected,
    listings,
    normal_url_sql,
    quote,
    scratch,
    sql_list,
    table,
    wide,
)
from feedloom.plans.text_queries import cohort_sql, folded_cte, location_sql, relevant_sql
from feedloom.runtime import land
from feedloom.sources import boards, company_pages, html, markdown, outcomes, pages, search, stories, structured

QUERIES = {}
SETTINGS = rules.Settings(filters=FILTERS, limits=rules.Limits(max_age_days=30))
STRIP_CHARS = "chr(32)||chr(10)||chr(9)||chr(13)"


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = (query, sql)
        return query

    return keep


def gate_sql(url: str = "apply_url") -> str:
    """Role, cohort and location rule over a folded listing."""
    return f"{relevant_sql()} AND {cohort_sql(chr(40) + 'title || chr(32) || ' + url + chr(41))} AND {location_sql('location_text')}"


# --- structured feeds ------------------------------------------------------------------------

FEED = rules.StructuredFeed(
    name="feed", url="https://feeds.example/new-grad.json", job_path="data.0.jobs", company_key="company_name",
    closed_key="filled", job_id_key="id",
)


def _joined(rows, group: str = "doc_id"):
    """Raw JSON rows gathered into payload bodies of forty rows."""
    return (
        rows.groupBy(F.floor(F.col(group) / 40).cast("int").alias("source_ordinal"))
        .agg(F.array_sort(F.collect_list(F.struct(group, "raw"))).alias("items"))
        .withColumn("raws", F.array_join(F.transform("items", lambda i: i["raw"]), ","))
        .drop("items")
        .withColumn("fetched_at", F.lit(AS_OF).cast("timestamp"))
    )


def _feed_payloads(spark, sf_dir):
    rows = listings(spark, sf_dir)
    common = [
        F.col("doc_id").alias("id"),
        F.col("company_name").alias("company_name"),
        F.concat(F.lit(" "), "title").alias("title"),
        F.col("apply_url").alias("url"),
        F.col("description_text").alias("description"),
        F.when(F.col("doc_id") % 13 == 5, False).alias("active"),
        F.when(F.col("doc_id") % 14 == 6, True).alias("filled"),
    ]
    text_place = F.to_json(
        F.struct(*common, F.coalesce("location_text", F.lit(" ")).alias("location"), F.col("posted_epoch").alias("posted_at"),
                 F.lit("true").alias("is_closed"))
    )
    list_place = F.to_json(
        F.struct(
            *common,
            F.when(F.col("location_text").isNull(), F.array().cast("array<string>"))
            .otherwise(F.array("location_text", F.lit("Remote")))
            .alias("location"),
            F.date_format(F.timestamp_seconds("posted_epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posted_at"),
            F.when(F.col("doc_id") % 15 == 7, True).alias("is_closed"),
        )
    )
    raw = F.when(F.col("doc_id") % 2 == 0, text_place).otherwise(list_place)
    bodies = _joined(rows.select("doc_id", raw.alias("raw")))
    return bodies.select(
        "source_ordinal", "fetched_at", F.concat(F.lit('{"data": [{"jobs": ['), "raws", F.lit("]}]}")).alias("body")
    )


_FEED_CTE = f"""{LISTINGS_CTE}, feed0 AS (SELECT * EXCLUDE (location_text, description_text),
        nullif(trim(CASE WHEN doc_id % 2 = 0 THEN coalesce(location_text, '') WHEN location_text IS NULL THEN '' ELSE location_text || ', Remote' END,
            CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END), '') AS location_text,
        trim(description_text, {STRIP_CHARS}) AS description_text FROM listings
        WHERE doc_id % 13 <> 5 AND doc_id % 14 <> 6 AND NOT (doc_id % 2 = 1 AND doc_id % 15 = 7)),
    {folded_cte('feed0')}"""


@register(
    "structured_feed",
    f"""WITH {_FEED_CTE} SELECT CAST(doc_id AS VARCHAR) AS external_job_id, company_name, title, apply_url, location_text,
        CAST(posted_epoch AS BIGINT) AS posted_epoch, md5(description_text) AS text_digest, doc_id // 40 AS source_ordinal, doc_id % 40 AS position
    FROM folded WHERE (posted_epoch IS NULL OR posted_epoch >= {AS_OF_EPOCH} - 30 * {DAY})
        AND {relevant_sql("description_text = ''")} AND {cohort_sql("(title || chr(32) || apply_url)")} AND {location_sql('location_text')}""",
)
def structured_feed(spark, sf_dir):
    rows = structured.feed_rows(_feed_payloads(spark, sf_dir), FEED)
    found = structured.collect_feed(structured.map_json_rows(rows, FEED), SETTINGS, AS_OF)
    return _feed_columns(found)


def _feed_columns(found):
    return found.select(
        "external_job_id",
        "company_name",
        "title",
        "apply_url",
        "location_text",
        F.unix_seconds("posted_at").alias("posted_epoch"),
        F.md5("description_text").alias("text_digest"),
        F.col("source_ordinal").cast("bigint").alias("source_ordinal"),
        F.col("position").cast("bigint").alias("position"),
    )


@register(
    "open_feed_rows",
    f"WITH {LISTINGS_CTE} SELECT doc_id // 40 AS source_ordinal, doc_id % 40 AS position, "
    "doc_id % 13 = 5 OR doc_id % 14 = 6 OR (doc_id % 2 = 1 AND doc_id % 15 = 7) AS closed FROM listings",
)
def open_feed_rows(spark, sf_dir):
    rows = structured.feed_rows(_feed_payloads(spark, sf_dir), FEED)
    return structured.map_json_rows(rows, FEED).select(
        F.col("source_ordinal").cast("bigint").alias("source_ordinal"), F.col("position").cast("bigint").alias("position"), "closed"
    )


_CSV_CTE = f"""{LISTINGS_CTE}, csv0 AS (SELECT * EXCLUDE (location_text, description_text), nullif(trim(location_text), '') AS location_text,
    trim(description_text, {STRIP_CHARS}) AS description_text FROM listings), {folded_cte('csv0')}"""


@register(
    "parsed_feeds",
    f"""WITH {LISTINGS_CTE} SELECT doc_id // 40 AS source_ordinal, CASE WHEN doc_id // 40 % 5 < 3 THEN count(*) END AS entries,
        doc_id // 40 % 5 <> 3 AS readable FROM listings GROUP BY 1, doc_id // 40 % 5""",
)
def parsed_feeds(spark, sf_dir):
    """Payloads parsed once for listings and outcome; one in five is broken, one holds a text in place of the list."""
    kind = F.col("source_ordinal") % 5
    body = F.when(kind == 3, F.concat(F.lit("{"), "body")).when(kind == 4, F.lit('{"data": [{"jobs": "none"}]}')).otherwise(F.col("body"))
    parsed = structured.parsed_payloads(_feed_payloads(spark, sf_dir).withColumn("body", body), FEED)
    entries = F.when(F.col("raws").isNotNull(), F.size("raws")).cast("bigint").alias("entries")
    return parsed.select(F.col("source_ordinal").cast("bigint").alias("source_ordinal"), entries, "readable")


@register(
    "csv_feed",
    f"""WITH {_CSV_CTE} SELECT CAST(doc_id AS VARCHAR) AS external_job_id, company_name, title, location_text, md5(description_text) AS text_digest
    FROM folded WHERE (posted_epoch IS NULL OR posted_epoch >= {AS_OF_EPOCH} - 30 * {DAY})
        AND {relevant_sql("description_text = ''")} AND {cohort_sql("(title || chr(32) || apply_url)")} AND {location_sql('location_text')}""",
)
def csv_feed(spark, sf_dir):
    """CSV files with a header, landed on the shared storage and read back; texts keep line breaks."""
    path = scratch(spark, "csv")
    rows = listings(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("company_name").alias("company"), "title", F.col("apply_url").alias("url"),
        F.col("location_text").alias("location"), F.col("posted_epoch").alias("posted_at"), F.col("description_text").alias("description"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    feed = rules.StructuredFeed(name="csv", url="https://feeds.example/c.csv", job_id_key="id")
    landed = structured.read_csv_feed(spark, path, 0, AS_OF)
    found = structured.collect_feed(structured.map_csv_rows(landed, feed), SETTINGS, AS_OF, "csv")
    return found.select("external_job_id", "company_name", "title", "location_text", F.md5("description_text").alias("text_digest"))


# --- Markdown --------------------------------------------------------------------------------


def _markdown_payloads(spark, sf_dir):
    """Two tables per document with different column orders; every tenth row continues the one above."""
    rows = listings(spark, sf_dir).filter("location_text is null or not contains(location_text, '|')")
    link = F.concat(F.lit('<a class="x" href="'), "apply_url", F.lit('">Apply</a>'))
    company = F.when(F.col("doc_id") % 10 == 7, "↳").otherwise(F.concat(F.lit("<strong>"), "company_name", F.lit("</strong>")))
    title = F.replace("title", F.lit("|"), F.lit("/"))
    age = F.concat((F.col("doc_id") % 60).cast("string"), F.when(F.col("doc_id") % 2 == 0, "d").otherwise("D"))
    place = F.coalesce("location_text", F.lit(""))
    first = F.concat_ws(" | ", F.lit("|"), company, title, place, link, age, F.lit("|"))
    second = F.concat_ws(" | ", F.lit("  |"), title, age, company, place, link, F.lit("|"))
    lines = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(first, r"^\| \| ", "| ")).otherwise(F.regexp_replace(second, r"^  \| \| ", "  | ")).alias("line"))
    grouped = lines.groupBy(F.floor(F.col("doc_id") / 40).cast("int").alias("source_ordinal")).agg(
        F.array_sort(F.collect_list(F.when(F.col("doc_id") % 2 == 0, F.struct("doc_id", "line")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("doc_id") % 2 == 1, F.struct("doc_id", "line")))).alias("b"),
    )

    def block(name):
        return F.array_join(F.transform(F.array_compact(name), lambda r: F.regexp_replace(r["line"], r"\| \|$", "|")), "\n")

    body = F.concat_ws(
        "\n", F.lit("# Jobs"), F.lit("| not a table yet | x | y | z |"),
        F.lit("| **Company** | Position | Location | Posting | Age |".replace("**", "")), F.lit("| --- | :-: | --- | --- | --- |"), block("a"),
        F.lit("text between"), F.lit("| Role | Age | Company | Location | Application |"), F.lit("|---|---|---|---|---|"), block("b"),
    )
    return grouped.select(
        "source_ordinal",
        F.concat(F.lit("new_grad-"), F.col("source_ordinal").cast("string")).alias("source_name"),
        F.lit("https://md.example/README.md").alias("source_url"),
        F.lit(AS_OF).cast("timestamp").alias("fetched_at"),
        body.alias("body"),
    )


_MD_CTE = f"""{LISTINGS_CTE}, md0 AS (SELECT * EXCLUDE (title, location_text), trim(regexp_replace(replace(title, '|', '/'), '\\s+', ' ', 'g')) AS title,
        nullif(trim(regexp_replace(location_text, '\\s+', ' ', 'g')), '') AS location_text FROM listings),
    folded AS (SELECT *, lower(title) AS t, lower(title || ' ') AS a FROM md0)"""


@register(
    "markdown_rows",
    f"WITH {LISTINGS_CTE} SELECT 'new_grad-' || doc_id // 40 AS source_name, count(*) AS available FROM listings GROUP BY 1",
)
def markdown_rows(spark, sf_dir):
    rows = markdown.table_rows(markdown.table_lines(_markdown_payloads(spark, sf_dir)))
    return rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("available"))


@register(
    "markdown_feed",
    f"""WITH {_MD_CTE} SELECT 'new_grad-' || doc_id // 40 AS source_name, company_name, title, location_text, apply_url,
        substr(sha256(apply_url), 1, 32) AS external_job_id, {AS_OF_EPOCH} - (doc_id % 60) * {DAY} AS posted_epoch
    FROM folded WHERE doc_id % 10 <> 7 AND doc_id % 60 <= 45 AND {relevant_sql("TRUE")}
        AND {cohort_sql("(title || chr(32) || apply_url)")} AND {location_sql('location_text')}""",
)
def markdown_feed(spark, sf_dir):
    found = markdown.collect_markdown(_markdown_payloads(spark, sf_dir), rules.Settings(filters=FILTERS), AS_OF)
    return found.select(
        "source_name", "company_name", "title", "location_text", "apply_url", "external_job_id", F.unix_seconds("posted_at").alias("posted_epoch")
    )


# --- job boards ------------------------------------------------------------------------------

_PLATFORMS = ("ashby", "gem", "greenhouse", "lever", "smartrecruiters", "workday")


def _board_rows(spark, sf_dir):
    """Raw postings in the shape of six platforms; payload 5, 15, ... of forty rows is unreadable."""
    rows = listings(spark, sf_dir)
    ident = F.col("doc_id").cast("string")
    place, posted = F.col("location_text"), F.date_format(F.timestamp_seconds("posted_epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.col("description_text")
    shapes = {
        "ashby": F.struct(ident.alias("id"), F.col("title"), F.col("apply_url").alias("applyUrl"), place.alias("location"),
                          posted.alias("publishedAt"), text.alias("descriptionHtml"), F.lit("FullTime").alias("employmentType")),
        "gem": F.struct(ident.alias("extId"), F.col("title"),
                        F.array(F.struct(place.alias("name")), F.struct(place.alias("name"))).alias("locations"),
                        F.struct(F.when(F.col("doc_id") % 2 == 0, "REMOTE").alias("locationType")).alias("job")),
        "greenhouse": F.struct(F.col("doc_id").alias("id"), F.col("title"), F.col("apply_url").alias("absolute_url"),
                               F.struct(place.alias("name")).alias("location"), posted.alias("updated_at"), text.alias("content")),
        "lever": F.struct(ident.alias("id"), F.col("title").alias("text"), F.col("apply_url").alias("hostedUrl"),
                          F.struct(place.alias("location")).alias("categories"), (F.col("posted_epoch") * 1000).alias("createdAt"),
                          text.alias("descriptionPlain")),
        "smartrecruiters": F.struct(ident.alias("id"), F.col("title").alias("name"), F.col("apply_url").alias("ref"),
                                    F.struct(place.alias("city"), F.lit("").alias("region")).alias("location"), posted.alias("releasedDate"),
                                    F.struct(F.struct(F.struct(text.alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd")),
        "workday": F.struct(F.array(F.col("title"), ident).alias("bulletFields"), place.alias("locationsText"), F.lit("Posted Today").alias("postedOn"),
                            F.col("apply_url").alias("externalPath"), text.alias("description")),
    }
    raw = None
    for number, name in enumerate(_PLATFORMS):
        condition = F.floor(F.col("doc_id") / 40) % 6 == number
        raw = F.when(condition, F.to_json(shapes[name])) if raw is None else raw.when(condition, F.to_json(shapes[name]))
    return rows.select("doc_id", raw.alias("raw"))


def _board_payloads(spark, sf_dir):
    bodies = _joined(_board_rows(spark, sf_dir))
    number = F.col("source_ordinal") % 6
    platform = F.element_at(F.array(*[F.lit(p) for p in _PLATFORMS]), number + 1)
    body = (
        F.when(F.col("source_ordinal") % 10 == 5, F.concat(F.lit('{"jobs": [{"broken": '), F.substring("raws", 1, 50)))
        .when(number == 0, F.concat(F.lit('{"jobs": ['), "raws", F.lit("]}")))
        .when(number == 1, F.concat(F.lit('{"data": {"oatsExternalJobPostings": {"jobPostings": ['), "raws", F.lit("]}}}")))
        .when(number == 2, F.concat(F.lit('{"jobs": ['), "raws", F.lit('], "meta": {"total": 40}}')))
        .when(number == 3, F.concat(F.lit("["), "raws", F.lit("]")))
        .when(number == 4, F.concat(F.lit('{"content": ['), "raws", F.lit("]}")))
        .otherwise(F.concat(F.lit('{"jobPostings": ['), "raws", F.lit("]}")))
    )
    return bodies.select(
        "source_ordinal",
        platform.alias("platform"),
        F.concat(F.lit("Board"), F.col("source_ordinal").cast("string")).alias("company_name"),
        F.concat(F.lit("b"), F.col("source_ordinal").cast("string")).alias("identifier"),
        F.concat(F.lit("https://api.example/"), F.col("source_ordinal").cast("string")).alias("api_url"),
        F.lit("").alias("careers_url"),
        "fetched_at",
        body.alias("body"),
    )


_BOARD_CTE = f"""{LISTINGS_CTE}, board0 AS (SELECT doc_id, doc_id // 40 AS g, (doc_id // 40) % 6 AS k, title, posted_epoch,
        CASE WHEN (doc_id // 40) % 6 = 1 THEN 'https://jobs.gem.com/b' || doc_id // 40 || '/' || doc_id ELSE apply_url END AS apply_url,
        CASE WHEN (doc_id // 40) % 6 <> 1 THEN location_text
             WHEN doc_id % 2 = 0 AND (location_text IS NULL OR NOT contains(lower(location_text), 'remote')) THEN CASE WHEN location_text IS NULL THEN 'Remote' ELSE 'Remote, ' || trim(location_text) END
             ELSE trim(location_text) END AS location_text,
        CASE WHEN (doc_id // 40) % 6 = 1 THEN '' ELSE description_text END AS description_text FROM listings),
    {folded_cte('board0')}, judged AS (SELECT *, CASE k WHEN 0 THEN 'ashby' WHEN 1 THEN 'gem' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'lever'
        WHEN 4 THEN 'smartrecruiters' ELSE 'workday' END || ':Board' || g AS source_name, {gate_sql()} AS passes FROM folded)"""


@register(
    "board_listings",
    f"""WITH {_BOARD_CTE} SELECT source_name, CAST(doc_id AS VARCHAR) AS external_job_id, title, apply_url, location_text, md5(description_text) AS text_digest,
        CASE WHEN k IN (1, 5) THEN NULL ELSE CAST(posted_epoch AS BIGINT) END AS posted_epoch FROM judged WHERE passes AND g % 10 <> 5""",
)
def board_listings(spark, sf_dir):
    found = boards.collect_boards(boards.judged_postings(_board_payloads(spark, sf_dir), FILTERS))
    return found.select(
        "source_name", "external_job_id", "title", "apply_url", "location_text", F.md5("description_text").alias("text_digest"),
        F.unix_seconds("posted_at").alias("posted_epoch"),
    )


@register(
    "board_outcomes",
    f"""WITH {_BOARD_CTE} SELECT source_name, CASE WHEN g % 10 = 5 THEN 'failed' ELSE 'healthy' END AS status,
        CASE WHEN g % 10 <> 5 THEN count(*) END AS total_available, CASE WHEN g % 10 = 5 THEN 0 ELSE count(*) FILTER (passes) END AS relevant_jobs
    FROM judged GROUP BY source_name, g UNION ALL SELECT 'taleo:' || n_name, 'unsupported', NULL, 0 FROM nation UNION ALL SELECT 'lever:' || r_name, 'failed', NULL, 0 FROM region""",
)
def board_outcomes(spark, sf_dir):
    payloads = _board_payloads(spark, sf_dir)
    judged = boards.judged_postings(payloads, FILTERS)
    listed = (
        payloads.select(F.concat_ws(":", "platform", "company_name").alias("source_name"), F.lit(True).alias("supported"))
        .unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("taleo:"), "n_name").alias("source_name"), F.lit(False).alias("supported")))
        .unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("lever:"), "r_name").alias("source_name"), F.lit(True).alias("supported")))
    )
    return outcomes.board_outcomes(listed, judged).select("source_name", "status", "total_available", "relevant_jobs")


# --- pages -----------------------------------------------------------------------------------

CITIES = ("Seattle|WA|US", "Toronto|ON|Canada", "Austin|TX|", "|CA|USA", "Berlin||Germany")
LINK_TEXTS = (
    "Software Engineer, New Grad 2027",
    "Senior Software Engineer, New Grad",
    "Software Engineer, Early Career San Francisco, California",
    "Backend Engineer, Entry Level - Toronto",
    "Software Engineer (Remote, US), New Grad",
    "About us",
)
_PAGE_TITLE = choose("page_id", TITLES)
_CITY = choose("page_id", CITIES)


def _job_pages(spark, sf_dir):
    """The given pages with a JSON-LD posting in one third and job links in another."""
    rows = wide(spark, sf_dir, "pages", "page_id").selectExpr("*", f"{_PAGE_TITLE} AS p_title", f"split({_CITY}, '[|]') AS city")
    address = F.struct(F.col("city")[0].alias("addressLocality"), F.col("city")[1].alias("addressRegion"), F.col("city")[2].alias("addressCountry"))
    posting = F.to_json(
        F.struct(
            F.lit("JobPosting").alias("@type"),
            F.col("p_title").alias("title"),
            F.concat(F.lit("&lt;p&gt;Work on page "), F.col("page_id").cast("string"), F.lit(" &amp;amp; more&lt;/p&gt;&lt;p&gt;entry level&lt;/p&gt;")).alias("description"),
            F.struct(F.concat(F.lit("Org "), F.col("page_id").cast("string")).alias("name")).alias("hiringOrganization"),
            F.array(F.struct(address.alias("address"))).alias("jobLocation"),
            F.struct(F.col("page_id").alias("value")).alias("identifier"),
            F.lit("2024-01-15").alias("datePosted"),
            F.concat(F.lit("/jobs/"), F.col("page_id").cast("string")).alias("url"),
        )
    )
    script = F.concat(F.lit('<html><head><script type="application/ld+json">{"@graph": [{"@type": "Thing"}, '), posting, F.lit("]}</script></head>"), "html")
    anchor = F.concat(
        "html", F.lit('<p><a href="/jobs/'), F.col("page_id").cast("string"), F.lit('"><b>'),
        F.element_at(F.array(*[F.lit(t) for t in LINK_TEXTS]), (F.floor(F.col("page_id") / 3) % 6 + 1).cast("int")), F.lit("</b></a>")
    )
    return rows.select(
        "page_id",
        "url",
        F.when(F.col("page_id") % 3 == 0, script).when(F.col("page_id") % 3 == 1, anchor).otherwise(F.col("html")).alias("html"),
    )


def _facts(spark, sf_dir):
    return html.page_facts(_job_pages(spark, sf_dir)).withColumns(
        {
            "source_name": F.concat(F.lit("company:"), F.col("page_id").cast("string")),
            "source_type": F.lit("company_page"),
            "source_ordinal": F.col("page_id").cast("int"),
            "company_name": F.lit(None).cast("string"),
            "priority_tier": (F.col("page_id") % 2 + 1).cast("int"),
        }
    )


_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PAGES_CTE = f"""p0 AS (SELECT page_id, url, {_PAGE_TITLE} AS title, string_split({_CITY}, '|') AS city FROM pages WHERE page_id % 3 = 0),
    p1 AS (SELECT page_id, url, title, array_to_string(list_filter(city, lambda c: c <> ''), ', ') AS location_text,
        'Work on page ' || page_id || ' & more entry level' AS description_text, {_ROOT} || '/jobs/' || page_id AS apply_url FROM p0),
    {folded_cte('p1')}"""


@register(
    "page_postings",
    f"""WITH {_PAGES_CTE} SELECT page_id, 'Org ' || page_id AS company_name, title, location_text, description_text, apply_url,
        CAST(page_id AS VARCHAR) AS external_job_id, '2024-01-15' AS posted FROM folded WHERE {relevant_sql()} AND {location_sql('location_text')}""",
)
def page_postings(spark, sf_dir):
    found = pages.posting_listings(_facts(spark, sf_dir), FILTERS)
    return found.select(
        "page_id", "company_name", "title", "location_text", "description_text", "apply_url", "external_job_id",
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted"),
    )


@register(
    "page_anchors",
    "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, "
    "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS label FROM pages) "
    "SELECT page_id, count(*) AS anchors, min(href) AS first_href FROM h WHERE trim(label) <> '' GROUP BY page_id",
)
def page_anchors(spark, sf_dir):
    facts = html.page_facts(wide(spark, sf_dir, "pages", "page_id"))
    rows = pages.anchor_rows(facts)
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"), F.min("anchor.href").alias("first_href"))


_LABEL = "CAST(floor(page_id / 3.0) AS BIGINT) % 6"
_ANCHORS = f"""SELECT page_id, {_ROOT} || '/jobs/' || page_id AS apply_url, CASE {_LABEL} WHEN 2 THEN 'San Francisco, California' END AS location_text,
        CASE {_LABEL} WHEN 0 THEN 'Software Engineer, New Grad 2027' WHEN 2 THEN 'Software Engineer, Early Career' ELSE 'Software Engineer (Remote, US), New Grad' END AS title
    FROM pages WHERE page_id % 3 = 1 AND {_LABEL} IN (0, 2, 4)"""


@register("anchor_listings", _ANCHORS)
def anchor_listings(spark, sf_dir):
    found = pages.fallback_listings(land(_facts(spark, sf_dir), "page-facts"), FILTERS, F.lit(True))
    return found.select("page_id", "title", "location_text", "apply_url")


@register(
    "company_page_listings",
    f"""WITH {_PAGES_CTE}, own AS (
        SELECT page_id, title FROM folded WHERE {relevant_sql()} AND {location_sql('location_text')}
        UNION ALL SELECT page_id, title FROM ({_ANCHORS}) WHERE page_id % 2 = 0)
    SELECT source_type, title, count(*) AS listings FROM (
        SELECT 'ats' AS source_type, 'Software Engineer, New Grad' AS title FROM pages WHERE page_id % 5 = 0
        UNION ALL SELECT 'company_page', title FROM own WHERE page_id % 5 <> 0) GROUP BY 1, 2""",
)
def company_page_listings(spark, sf_dir):
    """Pages whose boards gave jobs use these; the others fall back to their own listings."""
    facts = land(_facts(spark, sf_dir), "page-facts")
    board_jobs = facts.filter("page_id % 5 = 0").select(
        "page_id", F.lit("greenhouse:Found").alias("source_name"), F.lit("ats").alias("source_type"), F.lit("Software Engineer, New Grad").alias("title"),
        F.col("url").alias("apply_url"), "source_ordinal", F.lit(0).alias("position"), F.lit("Found").alias("company_name"),
    )
    found = pages.company_listings(facts, board_jobs, FILTERS)
    return found.groupBy("source_type", "title").agg(F.count(F.lit(1)).alias("listings"))


# A third of all pages link to one board, spelled in another case; some link to a board with or without a landed payload.
_HOT_BOARD = 2
_PAGE_LINKS = f"""links AS (SELECT page_id, {_HOT_BOARD} AS g, 'greenhouse' AS platform FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, (page_id % 7) * 6 + 3, 'lever' FROM pages WHERE page_id % 12 = 4)"""
_COMPANY_PAGES = f"""boards_ AS (WITH {_BOARD_CTE} SELECT g, k, title, apply_url, passes, g % 10 = 5 AS broken FROM judged), {_PAGE_LINKS},
    found AS (SELECT l.page_id, l.platform, b.title, b.apply_url, b.passes, b.broken FROM links l JOIN boards_ b ON b.g = l.g),
    answered AS (SELECT DISTINCT page_id FROM found WHERE passes AND NOT broken),
    own AS (WITH {_PAGES_CTE} SELECT page_id, 'Org ' || page_id AS company_name, title, apply_url FROM folded WHERE {relevant_sql()} AND {location_sql('location_text')}),
    listed AS (SELECT platform || ':Company ' || page_id AS source_name, 'ats' AS source_type, 'Company ' || page_id AS company_name, title, apply_url
            FROM found WHERE passes AND NOT broken
        UNION ALL SELECT 'company:c' || page_id, 'company_page', company_name, title, apply_url FROM own WHERE page_id NOT IN (SELECT page_id FROM answered)
        UNION ALL SELECT 'company:c' || page_id, 'company_page', 'Company ' || page_id, title, apply_url FROM ({_ANCHORS})
            WHERE page_id % 2 = 0 AND page_id NOT IN (SELECT page_id FROM answered))"""


def company_tables(spark, sf_dir):
    """Companies, one per page, their landed pages with links to boards, and the payloads of boards."""
    rows = _job_pages(spark, sf_dir)
    ident = F.col("page_id").cast("string")
    links = (
        F.when(F.col("page_id") % 3 == 0, F.lit(f'<a href="https://boards.greenhouse.io/B{_HOT_BOARD}">board</a>'))
        .when(F.col("page_id") % 12 == 4, F.concat(F.lit("https://jobs.lever.co/b"), (F.col("page_id") % 7 * 6 + 3).cast("string")))
        .when(F.col("page_id") % 12 == 10, F.concat(F.lit("https://jobs.ashbyhq.com/none-"), ident))
        .otherwise(F.lit(""))
    )
    landed = rows.filter("page_id % 11 <> 7").select(
        F.concat(F.lit("c"), ident).alias("slug"), F.col("page_id").cast("int").alias("source_ordinal"), "url",
        F.concat("html", links).alias("html"), F.lit("2024-02-01").cast("timestamp").alias("fetched_at"),
    )
    listed = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("company_id"), F.concat(F.lit("c"), ident).alias("slug"), F.concat(F.lit("Company "), ident).alias("name"),
        (F.col("page_id") % 2 + 1).cast("int").alias("priority_tier"), F.lit(True).alias("enabled"),
    )
    return listed, landed, _board_payloads(spark, sf_dir).drop("company_name")


def _company_pages(spark, sf_dir):
    settings = rules.Settings(filters=FILTERS)
    return company_pages.collect(*company_tables(spark, sf_dir), settings, land)


_LANDED = "CAST(split_part(source_name, CASE WHEN source_type = 'ats' THEN 'Company ' ELSE 'company:c' END, 2) AS BIGINT) % 11 <> 7"


@register("company_page_rows", f"WITH {_COMPANY_PAGES} SELECT * FROM listed WHERE {_LANDED}")
def company_page_rows(spark, sf_dir):
    """Scan list, boards found on the pages, their payloads, and the pages' own listings where boards gave none."""
    found, _ = _company_pages(spark, sf_dir)
    return found.select("source_name", "source_type", "company_name", "title", "apply_url")


@register(
    "company_page_outcomes",
    f"""WITH {_COMPANY_PAGES}, per_page AS (SELECT split_part(source_name, CASE WHEN source_type = 'ats' THEN 'Company ' ELSE 'company:c' END, 2) AS id, count(*) AS n FROM listed GROUP BY 1)
    SELECT 'company:c' || page_id AS source_name, CASE WHEN page_id % 11 = 7 THEN 'failed' ELSE 'healthy' END AS status, CAST(NULL AS BIGINT) AS total_available,
        CASE WHEN page_id % 11 = 7 THEN 0 ELSE coalesce(n, 0) END AS relevant_jobs, CASE WHEN page_id % 11 = 7 THEN 'no page was landed' END AS error
    FROM pages LEFT JOIN per_page ON id = CAST(page_id AS VARCHAR)
    UNION ALL SELECT 'discovered:' || platform || ':Company ' || page_id, CASE WHEN n IS NULL OR broken THEN 'failed' ELSE 'healthy' END,
        CASE WHEN NOT broken THEN n END, CASE WHEN NOT broken THEN relevant ELSE 0 END,
        CASE WHEN n IS NULL THEN 'no payload was landed' WHEN broken THEN 'payload is not a list' END
    FROM links LEFT JOIN (SELECT g, broken, count(*) AS n, count(*) FILTER (passes) AS relevant FROM boards_ GROUP BY 1, 2) USING (g) WHERE page_id % 11 <> 7
    UNION ALL SELECT 'discovered:ashby:Company ' || page_id, 'failed', NULL, 0, 'no payload was landed' FROM pages WHERE page_id % 12 = 10 AND page_id % 11 <> 7""",
)
def company_page_outcomes(spark, sf_dir):
    return _company_pages(spark, sf_dir)[1].drop("kind")


_LINKED = "page_id % 4 < 2"


@register(
    "discovered_boards",
    f"SELECT page_id, 'greenhouse' AS platform, 'Org' || page_id AS identifier FROM pages WHERE {_LINKED} "
    f"UNION ALL SELECT page_id, 'lever', 'lev-' || page_id FROM pages WHERE {_LINKED}",
)
def discovered_boards(spark, sf_dir):
    rows = wide(spark, sf_dir, "pages", "page_id")
    links = F.concat(
        F.lit('<a href="https://boards.greenhouse.io/Org'), F.col("page_id").cast("string"), F.lit('">a</a> HTTPS://job-boards.greenhouse.io/ORG'),
        F.col("page_id").cast("string"), F.lit(" http://jobs.lever.co/lev-"), F.col("page_id").cast("string"),
    )
    with_links = rows.withColumn("html", F.when(F.expr(_LINKED), F.concat("html", links)).otherwise(F.col("html")))
    return pages.discovered_boards(with_links).select("page_id", "platform", "identifier")


@register(
    "scan_list",
    "SELECT s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0 ORDER BY CASE WHEN s_name = 'Supplier#000000007' THEN 0 ELSE 1 END, s_suppkey % 4 + 1, lower(s_name) LIMIT 75",
)
def scan_list(spark, sf_dir):
    from feedloom.plans.testbed import companies

    return pages.scan_list(companies(spark, sf_dir), ("supplier#000000007",), 75).select("name")


@register(
    "page_descriptions",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Work on page ' || page_id || ' & more entry level' ELSE '' END AS description FROM pages",
)
def page_descriptions(spark, sf_dir):
    return pages.best_description(_facts(spark, sf_dir)).select("page_id", "description")


_ENRICH_URL = normal_url_sql("url")["normal"]


@register(
    "enriched_listings",
    f"""WITH {LISTINGS_CTE}, j AS (SELECT l.* EXCLUDE (apply_url, description_text), page_id, url, {_ENRICH_URL} AS n_url FROM listings l JOIN pages ON page_id = doc_id),
    u AS (SELECT n_url, arg_min(struct_pack(doc_id, page_id, title, posted_epoch, source_ordinal, position), struct_pack(source_ordinal, position)) AS f FROM j GROUP BY n_url),
    picked AS (SELECT f.* FROM u),
    d AS (SELECT doc_id, title, CASE WHEN page_id % 3 = 0 THEN 'Work on page ' || page_id || ' & more entry level' ELSE '' END AS description_text FROM picked)
    SELECT doc_id, description_text, sha256(CASE WHEN description_text = '' THEN title ELSE description_text END) AS description_hash,
        CASE WHEN description_text <> '' THEN 'true' END AS enriched FROM d""",
)
def enriched_listings(spark, sf_dir):
    """Sparse listings that point at a page with a posting get its description."""
    limits = rules.Limits(min_description_chars=20)
    jobs = _job_pages(spark, sf_dir)
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    rows = collected(spark, sf_dir).join(links, "doc_id")
    sparse = rows.withColumns({"apply_url": F.col("url"), "description_text": F.lit("")}).drop("url")
    picked = enrichment.pick_sparse(merge_duplicates(normalize(sparse)), limits)
    found = enrichment.found_descriptions(picked, jobs)
    patched = enrichment.patch_descriptions(picked, found, limits)
    return patched.select("doc_id", "description_text", "description_hash", F.col("metadata")["description_enriched"].alias("enriched"))


# --- search ----------------------------------------------------------------------------------


def _results(spark, sf_dir):
    """Search results derived from listings (two in three) and pages (one in three)."""
    found = listings(spark, sf_dir).select(
        (F.col("doc_id") % 8).cast("string").alias("query"), F.col("doc_id").alias("position"), "title", F.col("apply_url").alias("url"),
        F.lit("Great role").alias("snippet"), F.lit("engine").alias("source_name"), "posted_at",
    )
    from_pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 8).cast("string").alias("query"), (F.col("page_id") * 2).alias("position"), F.lit("Jobs").alias("title"), "url",
        F.lit(None).cast("string").alias("snippet"), F.lit("engine").alias("source_name"), F.lit(None).cast("timestamp").alias("posted_at"),
    )
    return found.unionByName(from_pages).withColumnRenamed("posted_at", "published_at").withColumn("source_ordinal", F.lit(0))


_RESULTS_CTE = f"""{LISTINGS_CTE}, results AS (SELECT CAST(doc_id % 8 AS VARCHAR) AS query, doc_id AS position, title, apply_url AS url FROM listings
    UNION ALL SELECT CAST(page_id % 8 AS VARCHAR), page_id * 2, 'Jobs', url FROM pages)"""


@register(
    "top_results",
    f"""WITH {_RESULTS_CTE}, r AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY position) AS rk FROM results)
    SELECT query, count(*) FILTER (rk <= 20) >= 20 AS full, min(position) AS first_position FROM r GROUP BY query""",
)
def top_results(spark, sf_dir):
    top = search.top_results(_results(spark, sf_dir), 20)
    return top.groupBy("query").agg((F.count(F.lit(1)) >= 20).alias("full"), F.min("position").alias("first_position"))


_COMPANY = """CASE WHEN contains(apply_url, 'jobs.ashbyhq.com') OR contains(apply_url, 'jobs.lever.co') OR contains(apply_url, 'greenhouse.io') THEN 'Acme' END"""


@register(
    "search_direct",
    f"""WITH {LISTINGS_CTE}, s AS (SELECT doc_id, apply_url, CASE title
            WHEN 'Associate Software Engineer (Remote, US)' THEN 'Associate Software Engineer'
            WHEN 'Product Engineer, New Graduate - Austin, TX' THEN 'Product Engineer, New Graduate'
            WHEN 'Software Developer | Early Career | Seattle' THEN 'Software Developer | Early Career' ELSE title END AS title, 'Great role' AS description_text,
            CASE title WHEN 'Associate Software Engineer (Remote, US)' THEN 'Remote, US' WHEN 'Product Engineer, New Graduate - Austin, TX' THEN 'Austin, TX'
            WHEN 'Software Developer | Early Career | Seattle' THEN 'Seattle' END AS location_text FROM listings),
    {folded_cte('s')} SELECT doc_id AS position, title, location_text, {_COMPANY} AS company_name, apply_url FROM folded
    WHERE {relevant_sql()} AND {location_sql('location_text')} AND {_COMPANY} IS NOT NULL""",
)
def search_direct(spark, sf_dir):
    found = search.direct_listings(_results(spark, sf_dir), FILTERS)
    return found.select("position", "title", "location_text", "company_name", "apply_url")


@register(
    "search_pages",
    f"""WITH {_PAGES_CTE}, own AS (
        SELECT page_id, 'json_ld' AS parser FROM folded WHERE {relevant_sql()} AND {location_sql('location_text')}
        UNION ALL SELECT page_id, 'anchor_fallback' FROM ({_ANCHORS}))
    SELECT CAST(r.page_id % 8 AS VARCHAR) AS search_query, parser, count(*) AS listings FROM pages r JOIN pages p ON p.url = r.url JOIN own ON own.page_id = p.page_id
    WHERE NOT regexp_matches(r.url, '^[a-z]+://([^/?#]*\\.)?google\\.com') GROUP BY 1, 2""",
)
def search_pages(spark, sf_dir):
    """Listings on the pages behind all results."""
    found = search.page_results(_results(spark, sf_dir), land(_facts(spark, sf_dir), "page-facts"), FILTERS)
    return found.groupBy("search_query", F.col("metadata")["parser"].alias("parser")).agg(F.count(F.lit(1)).alias("listings"))


_HOT_PAGE = "(SELECT min(url) FROM pages WHERE page_id = 1)"


def _many_results(spark, sf_dir):
    """``_results``, and as many again as there are listings that point to one page."""
    hot = table(spark, sf_dir, "pages").filter("page_id = 1").agg(F.min("url").alias("url"))
    again = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("hot"), (F.col("doc_id") % 5).cast("string")).alias("query"), F.col("doc_id").alias("position"), F.lit("Jobs").alias("title"),
        F.lit(None).cast("string").alias("snippet"), F.lit("engine").alias("source_name"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(0).alias("source_ordinal"),
    )
    # One address, a single row.
    return _results(spark, sf_dir).unionByName(again.crossJoin(F.broadcast(hot)))


@register(
    "search_listings",
    f"""WITH direct AS (WITH {LISTINGS_CTE}, s AS (SELECT doc_id, apply_url, CASE title
            WHEN 'Associate Software Engineer (Remote, US)' THEN 'Associate Software Engineer'
            WHEN 'Product Engineer, New Graduate - Austin, TX' THEN 'Product Engineer, New Graduate'
            WHEN 'Software Developer | Early Career | Seattle' THEN 'Software Developer | Early Career' ELSE title END AS title, 'Great role' AS description_text,
            CASE title WHEN 'Associate Software Engineer (Remote, US)' THEN 'Remote, US' WHEN 'Product Engineer, New Graduate - Austin, TX' THEN 'Austin, TX'
            WHEN 'Software Developer | Early Career | Seattle' THEN 'Seattle' END AS location_text FROM listings),
        {folded_cte('s')} SELECT CAST(doc_id % 8 AS VARCHAR) AS search_query, title, apply_url, 'search_result_direct' AS parser FROM folded
        WHERE {relevant_sql()} AND {location_sql('location_text')} AND {_COMPANY} IS NOT NULL),
    own AS (WITH {_PAGES_CTE} SELECT url, title, apply_url, 'json_ld' AS parser FROM folded WHERE {relevant_sql()} AND {location_sql('location_text')}
        UNION ALL SELECT url, title, a.apply_url, 'anchor_fallback' FROM ({_ANCHORS}) a JOIN pages USING (page_id)),
    asked AS (SELECT CAST(page_id % 8 AS VARCHAR) AS search_query, url FROM pages UNION ALL SELECT 'hot' || doc_id % 5, {_HOT_PAGE} FROM documents)
    SELECT * FROM direct UNION ALL SELECT search_query, title, apply_url, parser FROM asked JOIN own USING (url)
        WHERE NOT regexp_matches(url, '^[a-z]+://([^/?#]*\\.)?google\\.com')""",
)
def search_listings(spark, sf_dir):
    """Direct listings and those of the pages behind; one address behind a third of all results is dealt out."""
    found = search.search_listings(_many_results(spark, sf_dir), land(_facts(spark, sf_dir), "page-facts"), FILTERS, per_salt=1000)
    return found.select("search_query", "title", "apply_url", F.col("metadata")["parser"].alias("parser"))


# --- stories ---------------------------------------------------------------------------------


def story_pages(spark, sf_dir):
    """Story pages derived from pages: three elements, two of them the same file; every ninth page
    is a challenge, every tenth names another profile, every eleventh advertises more items."""
    number = F.col("page_id")
    ident = number.cast("string")

    def element(letter, kind, file):
        return F.concat(
            F.lit('<span data-type="stories" data-id="v'), ident, F.lit(f'{letter}" data-slide="{ord(letter) - 97}" data-media-type="{kind}" data-content="https://cdn.example/'),
            ident, F.lit(f'/{letter}" data-filename="media/'), ident, F.lit(f'-{file}"></span>')
        )

    title = F.when(number % 9 == 4, "Just a moment").when(number % 10 == 3, "someone else").otherwise("Tester_1 Stories")
    counter = F.when(number % 11 == 5, "47").otherwise("2")
    body = F.concat(
        F.lit("<html><head><title>"), title, F.lit('</title></head><body><div class="profile__stories-counter">'), counter, F.lit("</div>"),
        element("a", "image", "one.heic"), element("b", "image", "one.heic"), element("c", "gif", "two.mp4"),
        F.lit('<span data-type="stories" data-id="x" data-content="ftp://no"></span>'), "html", F.lit("</body></html>"),
    )
    return table(spark, sf_dir, "pages").select("page_id", body.alias("html"))


@register(
    "story_items",
    """SELECT page_id, NULL AS failure, substr(sha256(page_id || '-one.heic'), 1, 32) AS key, 'image' AS media_type, 0 AS slide FROM pages
        WHERE page_id % 9 <> 4 AND page_id % 10 <> 3 AND page_id % 11 <> 5
    UNION ALL SELECT page_id, NULL, substr(sha256(page_id || '-two.mp4'), 1, 32), 'unknown', 2 FROM pages WHERE page_id % 9 <> 4 AND page_id % 10 <> 3 AND page_id % 11 <> 5
    UNION ALL SELECT page_id, CASE WHEN page_id % 9 = 4 THEN 'challenge page' WHEN page_id % 10 = 3 THEN 'unexpected profile'
        ELSE 'advertised 47 items but exposed only 2' END, NULL, NULL, NULL FROM pages WHERE page_id % 9 = 4 OR page_id % 10 = 3 OR page_id % 11 = 5""",
)
def story_items(spark, sf_dir):
    return stories.story_items(story_pages(spark, sf_dir), "tester_1").select("page_id", "failure", "key", "media_type", "slide")
