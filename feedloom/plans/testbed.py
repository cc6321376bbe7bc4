"""Listing-like tables derived from the given tables, for the registered queries.

The derivations are SQL expressions that Spark and DuckDB read alike, so that both sides of a check
start from the same rows; the operators under test are written separately on each side. Every
derived table grows with its base table. A third of all listings share one requisition, one source
row in three belongs to one company: the skew that the operators must stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.operators.normalize import normalize
from feedloom.runtime import checkpoint_folder, spread

# An invented deployment: the families it leaves out and the skills of the person it serves.
EXAMPLE_FAMILIES = ("Analyst", "Embedded", "Site Reliability", "Quality")
EXAMPLE_SKILLS = ("Python", "Java", "Go", "SQL", "React", "Docker", "Linux", "Git", "Kubernetes")
FILTERS = rules.Filters(excluded_families=EXAMPLE_FAMILIES)
AS_OF = "2024-02-10 00:00:00"
AS_OF_EPOCH = 1707523200
DAY = 86400
BASE_EPOCH = 1704067200

TITLES = (
    "Software Engineer, New Grad 2027",
    "Senior Software Engineer",
    "Software Engineer II",
    "Software Engineer - New Grad",
    "Associate Software Engineer (Remote, US)",
    "Backend Engineer, Early Career",
    "Software Engineer I",
    "Data Analyst, Entry Level",
    "Software Engineer, Mid",
    "Technical Support Engineer",
    "Frontend Engineer - University Graduate 2026",
    "Product Engineer, New Graduate - Austin, TX",
    "Site Reliability Engineer, New Grad",
    "Full-Stack Software Engineer",
    "Software Developer | Early Career | Seattle",
    "Staff Platform Architect",
    "Embedded Software Engineer, New Grad",
)
PLACES = (
    "Remote, United States",
    "  New   York, NY ",
    "SF",
    "Toronto, ON, Canada",
    "Remote - Canada",
    "Seattle, WA",
    "Milwaukee",
    "Hybrid - Austin, TX",
    "London, United Kingdom",
    "",
    "Springfield, IL; Denver, CO",
    "Berlin",
    "US",
)
SNIPPETS = (
    " Requires 5+ years of professional experience.",
    " Salary is $120,000 - $145,000 per year. We cannot provide visa sponsorship.",
    " Must be a U.S. citizen, eligible for a security clearance. Apply by August 15, 2026.",
    " Candidates graduating in 2027 with Python, React and TypeScript.",
    " Hybrid role; will sponsor. Docker, Kubernetes, AWS and PostgreSQL.",
    " Entry level, 0-2 years. Backend APIs in Go and Rust.",
    " On-site. At least 3 years of experience. C++ compiler and graphics work.",
    " For the class of 2026, graduation in 2026. Leetcode style interview, system design.",
    " Fully remote. Collaborate with product and customer teams on web application features.",
    " USD $45 - $60/hr. Deadline: 2026-09-30. Sponsorship is available to some, 1 year.",
    "",
)


def choose(index: str, values: tuple[str, ...]) -> str:
    """SQL CASE that picks a text by a number modulo the number of texts."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {cases} END"


_REQ = "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id - doc_id % 2 + 1 END"
_KIND = "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(floor(doc_id / 2.0) AS BIGINT) % 7 END"
_HASH = f"md5(CAST({_REQ} AS STRING))"
_UUID = (
    f"substr({_HASH}, 1, 8) || '-' || substr({_HASH}, 9, 4) || '-' || substr({_HASH}, 13, 4) || '-' || "
    f"substr({_HASH}, 17, 4) || '-' || substr({_HASH}, 21, 12)"
)
_R = f"CAST({_REQ} AS STRING)"
URL_SQL = f"""CASE {_KIND}
    WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || {_R} || CASE WHEN doc_id % 2 = 0 THEN '?gh_src=' || source ELSE '/' END
    WHEN 1 THEN 'https://jobs.lever.co/Acme/' || {_UUID} || CASE WHEN doc_id % 2 = 0 THEN '/apply' ELSE '' END
    WHEN 2 THEN 'https://jobs.ashbyhq.com/acme/' || {_UUID} || CASE WHEN doc_id % 2 = 0 THEN '/application?embed=true' ELSE '' END
    WHEN 3 THEN 'https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/Remote/Engineer_JR-' || {_R}
    WHEN 4 THEN 'https://careers.icims.com/jobs/' || {_R} || '/engineer/job'
    WHEN 5 THEN 'http://www.Example.org/careers/role-' || {_R} || '/?utm_source=' || source || '&b=2&a=' || CAST(({_REQ}) % 5 AS STRING) || '#top'
    ELSE 'https://acme.example.com/jobs?gh_jid=' || {_R} || '&ref=' || source END"""

COMPANIES = ("OpenAI", "Stripe", "Supplier#000000003", "SUPPLIER#000000007", "Nooks", "Supplier#000000012", "figma")

LISTING_SQL = {
    "doc_id": "doc_id",
    "source_ordinal": "CAST(substr(source, 4) AS INT)",
    "position": "doc_id",
    "source_name": "source",
    "source_type": "'structured'",
    "source_url": "'https://feeds.example/' || source",
    "apply_url": URL_SQL,
    "company_name": f"CASE WHEN doc_id % 3 = 0 THEN 'Supplier#000000000' ELSE {choose('doc_id', COMPANIES)} END",
    "title": choose("doc_id", TITLES),
    "external_job_id": "CAST(doc_id AS STRING)",
    "location_text": f"nullif({choose('doc_id * 5', PLACES)}, '')",
    "posted_epoch": f"CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {BASE_EPOCH} + (doc_id % 40) * {DAY} END",
    "description_text": f"CASE WHEN doc_id % 17 = 4 THEN '' ELSE text || {choose('doc_id', SNIPPETS)} END",
    "confidence": "CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.55 ELSE 0.6 END",
}
LISTINGS_CTE = (
    "listings AS (SELECT "
    + ", ".join(
        f"CAST({sql} AS DOUBLE) AS {name}" if name == "confidence" else f"{sql} AS {name}"
        for name, sql in LISTING_SQL.items()
    )
    + " FROM documents)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of long texts, spread over the cores if it came as one block."""
    return spread(table(spark, sf_dir, name), key)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings derived from ``documents``; whole texts are kept."""
    rows = wide(spark, sf_dir, "documents", "doc_id").selectExpr(*[f"{sql} AS {name}" for name, sql in LISTING_SQL.items()])
    return rows.withColumn("confidence", F.col("confidence").cast("double")).withColumn(
        "posted_at", F.timestamp_seconds("posted_epoch")
    )


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        listings(spark, sf_dir)
        .withColumns(
            {
                "job_family": F.lit(None).cast("string"),
                "employment_type": F.lit(None).cast("string"),
                "search_query": F.lit(None).cast("string"),
                "fetched_at": F.lit(AS_OF).cast("timestamp"),
                "metadata": F.create_map(F.lit("feed"), F.col("source_name")),
                "raw_job_id": F.concat(F.lit("r1-"), F.col("doc_id").cast("string")),
            }
        )
        .drop("posted_epoch")
    )


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(collected(spark, sf_dir))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company dimension derived from ``supplier``."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("company_id"),
        F.concat(F.lit("slug-"), F.col("s_suppkey").cast("string")).alias("slug"),
        F.col("s_name").alias("name"),
        (F.col("s_suppkey") % 4 + 1).cast("int").alias("priority_tier"),
        (F.col("s_suppkey") % 5 != 0).alias("enabled"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ledger derived from ``events``: one run per day, every seventh one failed."""
    day = F.to_date("ts")
    number = F.datediff(F.col("d"), F.lit("2024-01-01").cast("date"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(day.alias("d"))
        .agg(F.min("ts").cast("timestamp").alias("started_at"))
        .select(
            F.col("d").cast("string").alias("run_id"),
            F.when(number % 7 == 3, "failed").otherwise("completed").alias("status"),
            "started_at",
        )
    )


RUNS_CTE = """runs AS (
    SELECT CAST(d AS VARCHAR) AS run_id,
           CASE WHEN date_diff('day', DATE '2024-01-01', d) % 7 = 3 THEN 'failed' ELSE 'completed' END AS status,
           started_at
    FROM (SELECT CAST(ts AS DATE) AS d, min(ts) AS started_at FROM events GROUP BY 1))"""


def health_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source health derived from ``events``: source = user, run = day, purchases = listings."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").cast("string").alias("run_id"), F.col("user_id").cast("string").alias("source_name"))
        .agg(
            F.count_if(F.col("event_type") == "purchase").alias("total_available"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.count(F.lit(1)).alias("events"),
        )
        .select(
            "run_id",
            "source_name",
            F.when((F.col("errors") == F.col("events")) & (F.col("events") > 1), "failed")
            .otherwise("healthy")
            .alias("status"),
            "total_available",
            F.col("total_available").alias("relevant_jobs"),
            F.lit(None).cast("string").alias("error"),
        )
    )


HEALTH_CTE = """health AS (
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, CAST(user_id AS VARCHAR) AS source_name,
           CASE WHEN count(*) FILTER (event_type = 'error') = count(*) AND count(*) > 1
                THEN 'failed' ELSE 'healthy' END AS status,
           count(*) FILTER (event_type = 'purchase') AS total_available
    FROM events GROUP BY 1, 2)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage that the session names."""
    import uuid

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- SQL text for oracles --------------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(column: str, words) -> str:
    """OR of substring tests."""
    tests = " OR ".join(f"contains({column}, {quote(w)})" for w in words)
    return f"({tests})" if tests else "FALSE"


def sql_list(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def sql_regex(column: str, pattern: str, options: str = "") -> str:
    extra = f", '{options}'" if options else ""
    return f"regexp_matches({column}, {quote(pattern)}{extra})"


# Normal form of a URL, for URLs without percent escapes (the given ones have none).
def normal_url_sql(url: str) -> dict[str, str]:
    split = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    path = f"regexp_replace(regexp_extract({url}, '{split}', 3), '/+$', '')"
    drop = "('embed','gh_src','source','ref','referrer')"
    pairs = (
        f"list_sort(list_transform(list_filter(string_split(regexp_extract({url}, '{split}', 4), '&'), "
        f"lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {drop} AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')), "
        f"lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END))"
    )
    host = f"regexp_replace(lower(regexp_extract({url}, '{split}', 2)), '^www\\.', '')"
    bare = f"regexp_replace({path}, '(?i)/(?:application|apply)/?$', '')"
    return {
        "host": host,
        "path": bare,
        "pairs": pairs,
        "normal": f"'https://' || {host} || {bare} || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END",
    }


def identity_cte(source: str = "listings") -> str:
    """CTE ``identified``: the listings with their identity, written without the operator's help."""
    n = normal_url_sql("apply_url")
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return f"""url_parts AS (
        SELECT *, {n['host']} AS u_host, {n['path']} AS u_path, {n['pairs']} AS u_pairs, {n['normal']} AS normalized_url
        FROM {source}),
    url_ids AS (
        SELECT *, regexp_extract(array_to_string(u_pairs, '&'), '(?:^|&)gh_jid=([0-9]+)(?:&|$)', 1) AS q_id,
               lower(regexp_extract(u_path, '(?i)/([^/]+/{uuid})(?:/|$)', 1)) AS org_uuid,
               regexp_extract(u_path, '/jobs/(\\d+)(?:/|$)', 1) AS job_no,
               lower(regexp_extract(u_path, '(?i)_((?:JR|R)[A-Z0-9-]+)$', 1)) AS wd_no
        FROM url_parts),
    identified AS (
        SELECT * EXCLUDE (ats_identity), ats_identity,
               CASE WHEN ats_identity IS NOT NULL THEN 'ats::' || ats_identity ELSE 'url::' || normalized_url END AS primary_identity,
               sha256(CASE WHEN ats_identity IS NOT NULL THEN 'ats::' || ats_identity ELSE 'url::' || normalized_url END) AS canonical_key
        FROM (SELECT *, CASE
            WHEN q_id <> '' THEN 'greenhouse::' || q_id
            WHEN contains(u_host, 'ashbyhq.com') AND org_uuid <> '' THEN 'ashby::' || replace(org_uuid, '/', '::')
            WHEN contains(u_host, 'lever.co') AND org_uuid <> '' THEN 'lever::' || replace(org_uuid, '/', '::')
            WHEN contains(u_host, 'greenhouse') AND job_no <> '' THEN 'greenhouse::' || job_no
            WHEN contains(u_host, 'myworkdayjobs.com') AND wd_no <> '' THEN 'workday::' || u_host || '::' || wd_no
            WHEN contains(u_host, 'icims.com') AND job_no <> '' THEN 'icims::' || u_host || '::' || job_no
        END AS ats_identity FROM url_ids))"""
