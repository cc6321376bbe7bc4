"""Registered queries: scoring, digest, alerts and their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.details import detail_items
from feedloom.functions.scoring import score
from feedloom.operators import digest, ranking
from feedloom.plans import text_queries
from feedloom.plans.testbed import (
    AS_OF,
    EXAMPLE_SKILLS,
    AS_OF_EPOCH,
    DAY,
    LISTINGS_CTE,
    companies,
    identity_cte,
    normalized,
    quote,
    sql_any,
    sql_list,
    sql_regex,
)

PROFILE = rules.Profile(skills=EXAMPLE_SKILLS, internships=("Intern at Acme", "Intern at Example"))
THRESHOLDS = rules.Thresholds(digest_min_fit=20, high_signal_fit=40, top_priority_fit=65, alert_fit=60)
QUERIES = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = (query, sql)
        return query

    return keep


def tiers(spark, sf_dir):
    return ranking.company_tiers(companies(spark, sf_dir), ("Nooks", "Supplier#000000012"))


def scored(spark, sf_dir):
    """Every derived listing with its rule score."""
    jobs = ranking.with_tier(normalized(spark, sf_dir), tiers(spark, sf_dir), "doc_id")
    return score(jobs, PROFILE)


def ranked(spark, sf_dir):
    """Scored listings with a lifecycle derived from their number."""
    return scored(spark, sf_dir).withColumns(
        {
            "lifecycle_state": F.expr("CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' WHEN 2 THEN 'reopened' ELSE 'new' END"),
            "first_seen_at": F.expr("timestamp_seconds(1704067200 + (doc_id % 25) * 86400)"),
            "prev_fit_score": F.expr("CASE WHEN doc_id % 4 = 2 AND doc_id % 3 = 1 THEN CAST(doc_id % 90 AS INT) END"),
            "run_id": F.lit("r1"),
        }
    )


# --- the same rules as SQL, one CASE sum per group ------------------------------------------


def _sum(*cases: tuple[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in cases) + ")"


def _x(words) -> str:
    return sql_any("x", words)


_SKILLS = {owned: [
    f"CASE WHEN {_x(words)} THEN {quote(skill)} END"
    for skill, words in rules.SKILL_WORDS.items()
    if (skill in PROFILE.skills) == owned
] for owned in (True, False)}
_HEAVY = f"({sql_any('tl', rules.FIT_SENIOR_TITLE_WORDS)} OR years >= 5)"
_MISMATCH = _x(rules.MISMATCH_WORDS)
_TAGS = ", ".join(
    [f"CASE WHEN {_x(words)} THEN '{tag}' END" for tag, words in rules.ROLE_TAG_WORDS.items()]
    + ["CASE WHEN is_remote THEN 'remote' END", f"CASE WHEN {_x(rules.ENTRY_TAG_WORDS)} THEN 'entry_level' END"]
)
FIT_SQL = {
    "role_match": _sum((_x(rules.FIT_ROLE_WORDS), 22), (_x(rules.FIT_FRONTEND_WORDS), 5), (_x(rules.FIT_BACKEND_WORDS), 5)),
    "graduation_match": _sum((_x(rules.FIT_GRADUATE_WORDS), 15))
    + f" + CASE WHEN contains(x, '2027') THEN 5 WHEN {_x(rules.FIT_JUNIOR_YEARS_WORDS)} THEN 6 ELSE 0 END",
    "entry_level_signal": _sum((_x(rules.FIT_ENTRY_WORDS), 8)),
    "skill_overlap": "least(18, 3 * len(owned))",
    "product_profile": _sum((_x(rules.FIT_PRODUCT_WORDS), 6)),
    "experience_signal": _sum((_x(rules.FIT_EXPERIENCE_WORDS), 2)),
    "location_match": "CASE WHEN is_remote OR contains(lower(coalesce(location_text, '')), 'united states') "
    "OR contains(lower(coalesce(location_text, '')), 'remote') THEN 4 ELSE 0 END",
    "seniority_penalty": f"CASE WHEN {_HEAVY} THEN -35 WHEN years >= 2 THEN -18 ELSE 0 END",
    "seniority_match": f"CASE WHEN {_HEAVY} THEN 0 WHEN years >= 2 THEN 0 ELSE 4 END",
    "role_penalty": f"CASE WHEN {_MISMATCH} THEN -40 ELSE 0 END",
    "brand_bonus": "CASE tier WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END",
}
HARD_SQL = {
    "baseline": "25",
    "company_bar": f"CASE WHEN company_name IN {sql_list(rules.HIGH_BAR_COMPANIES)} THEN 28 WHEN tier = 1 THEN 14 WHEN tier = 2 THEN 9 ELSE 0 END",
    "niche_requirements": _sum((_x(rules.DIFFICULTY_NICHE_WORDS), 12)),
    "missing_skills": "least(20, 4 * len(unowned))",
    "competition": _sum((_x(rules.DIFFICULTY_CROWD_WORDS), 10)),
    "interview_bar": _sum((_x(rules.DIFFICULTY_INTERVIEW_WORDS), 8)),
    "ambiguity": _sum((_x(rules.DIFFICULTY_VAGUE_WORDS), 5)),
    "match_discount": "CASE WHEN len(owned) >= 5 THEN -5 ELSE 0 END",
}


def _why(prefix: str, names, labels) -> str:
    parts = ", ".join(
        f"CASE WHEN {prefix}_{n} > 0 THEN {quote(labels.get(n, n))} END" for n in names
    )
    return f"array_to_string(list_filter([{parts}], lambda v: v IS NOT NULL), '; ')"


def scored_cte(source: str = "listings") -> str:
    fit_cols = ", ".join(f"CAST({sql} AS INT) AS f_{name}" for name, sql in FIT_SQL.items())
    hard_cols = ", ".join(f"CAST({sql} AS INT) AS h_{name}" for name, sql in HARD_SQL.items())
    fit_sum = " + ".join(f"f_{n}" for n in FIT_SQL)
    hard_sum = " + ".join(f"h_{n}" for n in HARD_SQL)
    years = rules.REQUIRED_YEARS_PATTERN
    strip = "trim({0}, chr(32)||chr(10)||chr(9)||chr(13))".format("description_text")
    return f"""tier_names AS (
        SELECT lower(s_name) AS company_key, CASE WHEN s_name = 'Supplier#000000012' THEN 1 ELSE s_suppkey % 4 + 1 END AS tier FROM supplier
        UNION SELECT 'nooks', 1
        UNION SELECT 'supplier#000000012', 1),
    sc0 AS (
        SELECT l.*, lower(title || ' ' || {strip} || ' ' || coalesce(location_text, '')) AS x, lower(title) AS tl,
               coalesce({sql_any('lower(location_text)', rules.REMOTE_WORDS)}, FALSE) AS is_remote, coalesce(t.tier, 3) AS tier
        FROM {source} l LEFT JOIN tier_names t ON t.company_key = lower(l.company_name)),
    sc1 AS (
        SELECT *, list_filter([{', '.join(_SKILLS[True])}], lambda v: v IS NOT NULL)[1:6] AS owned,
               list_filter([{', '.join(_SKILLS[False])}], lambda v: v IS NOT NULL)[1:6] AS unowned,
               coalesce(list_max(list_filter(list_transform(list_filter(list_concat(regexp_extract_all(x, '{years}', 1), regexp_extract_all(x, '{years}', 2)),
                   lambda v: v <> ''), lambda v: CAST(v AS INT)), lambda v: v <= 15)), 0) AS years
        FROM sc0),
    sc2 AS (SELECT *, {fit_cols}, {hard_cols}, {_MISMATCH} AS mismatch,
               CASE WHEN {_MISMATCH} THEN NULL WHEN {sql_any('tl', rules.FIT_EXPLICIT_ENTRY_WORDS)} THEN 65
                    WHEN contains(title, '2027') AND {sql_any('tl', rules.FIT_TARGET_YEAR_ROLES)} THEN 60 ELSE 0 END AS fit_floor FROM sc1),
    sc3 AS (SELECT *, CAST({fit_sum} AS INT) AS raw_fit, CAST({hard_sum} AS INT) AS raw_hard FROM sc2),
    sc4 AS (SELECT *, CASE WHEN fit_floor > raw_fit THEN fit_floor - raw_fit ELSE 0 END AS f_explicit_entry_floor FROM sc3),
    scored AS (SELECT *, CAST(greatest(0, least(100, raw_fit + f_explicit_entry_floor)) AS INT) AS fit_score,
               CAST(greatest(0, least(100, raw_hard)) AS INT) AS difficulty_score,
               CASE WHEN mismatch OR greatest(0, least(100, raw_fit + f_explicit_entry_floor)) < 45 THEN 'skip'
                    WHEN raw_fit + f_explicit_entry_floor >= 80 THEN 'apply_now' WHEN raw_fit + f_explicit_entry_floor >= 65 THEN 'apply_if_interested'
                    ELSE 'low_priority' END AS recommendation,
               list_sort(list_filter([{_TAGS}, CASE WHEN tier = 1 THEN 'priority_company' END, CASE WHEN raw_hard >= 70 THEN 'reach' END], lambda v: v IS NOT NULL)) AS tags,
               {_why('f', [*FIT_SQL, 'explicit_entry_floor'], rules.FIT_LABELS)} AS fit_why,
               {_why('h', list(HARD_SQL), rules.DIFFICULTY_LABELS)} AS hard_why FROM sc4)"""


RANKED_CTE = f"""{LISTINGS_CTE}, {scored_cte()}, ranked AS (SELECT *,
    CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' WHEN 2 THEN 'reopened' ELSE 'new' END AS lifecycle_state,
    {1704067200} + (doc_id % 25) * 86400 AS first_epoch,
    CASE WHEN doc_id % 4 = 2 AND doc_id % 3 = 1 THEN CAST(doc_id % 90 AS INT) END AS prev_fit_score FROM scored)"""


@register(
    "scored_listings",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, tier AS company_tier, fit_score, difficulty_score, recommendation FROM scored",
)
def scored_listings(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.col("company_tier").cast("bigint").alias("company_tier"), "fit_score", "difficulty_score", "recommendation")


@register(
    "fit_groups",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, "
    + ", ".join(f"f_{n} AS {n}" for n in [*FIT_SQL, "explicit_entry_floor"])
    + " FROM scored",
)
def fit_groups(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "fit_groups.*")


@register(
    "difficulty_groups",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, " + ", ".join(f"h_{n} AS {n}" for n in HARD_SQL) + " FROM scored",
)
def difficulty_groups(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "difficulty_groups.*")


@register(
    "skills_and_tags",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, array_to_string(owned, ',') AS matching, "
    "array_to_string(unowned, ',') AS missing, array_to_string(tags, ',') AS tags FROM scored",
)
def skills_and_tags(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "doc_id",
        F.array_join("top_matching_skills", ",").alias("matching"),
        F.array_join("missing_or_weaker_skills", ",").alias("missing"),
        F.array_join("tags", ",").alias("tags"),
    )


_FIT_SENTENCE = "'Fit ' || fit_score || '/100 — ' || CASE WHEN fit_why = '' THEN 'limited overlap with target profile' ELSE fit_why END || '.'"
_HARD_SENTENCE = "'Difficulty ' || difficulty_score || '/100 — ' || hard_why || '.'"


@register(
    "score_explanations",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, {_FIT_SENTENCE} AS fit_summary, {_HARD_SENTENCE} AS difficulty_summary FROM scored",
)
def score_explanations(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "fit_summary", "difficulty_summary")


_ELIGIBLE = f"lifecycle_state IN ('new', 'reopened') AND fit_score >= {THRESHOLDS.digest_min_fit} AND recommendation <> 'skip'"
_SECTION = (
    f"CASE WHEN fit_score >= {THRESHOLDS.top_priority_fit} THEN 'Best matches' "
    f"WHEN fit_score >= {THRESHOLDS.high_signal_fit} THEN 'Also worth a look' ELSE 'Lower priority' END"
)
_TIE = ["source_ordinal", "position"]


@register(
    "digest_top",
    f"WITH {RANKED_CTE} SELECT doc_id, title, company_name, fit_score, difficulty_score, {_SECTION} AS section FROM ranked "
    f"WHERE {_ELIGIBLE} ORDER BY fit_score DESC, difficulty_score, source_ordinal, position LIMIT {THRESHOLDS.max_digest_jobs}",
)
def digest_top(spark, sf_dir):
    top = digest.top_matches(ranked(spark, sf_dir), THRESHOLDS, _TIE)
    return top.select("doc_id", "title", "company_name", "fit_score", "difficulty_score", digest.section(THRESHOLDS).alias("section"))


@register(
    "digest_per_source",
    f"WITH {RANKED_CTE}, p AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY fit_score DESC, difficulty_score, "
    f"source_ordinal, position) AS place FROM ranked WHERE {_ELIGIBLE}) "
    f"SELECT source_name, place, doc_id, fit_score FROM p WHERE place <= {THRESHOLDS.max_digest_jobs}",
)
def digest_per_source(spark, sf_dir):
    top = digest.top_matches_per(ranked(spark, sf_dir), "source_name", THRESHOLDS, _TIE)
    return top.select("source_name", F.col("place").cast("bigint").alias("place"), "doc_id", "fit_score")


@register(
    "immediate_alerts",
    f"WITH {RANKED_CTE} SELECT doc_id, fit_score, recommendation FROM ranked WHERE lifecycle_state IN ('new', 'reopened') "
    f"AND fit_score >= {THRESHOLDS.alert_fit} AND recommendation IN ('apply_now', 'apply_if_interested')",
)
def immediate_alerts(spark, sf_dir):
    return ranked(spark, sf_dir).filter(digest.alert_filter(THRESHOLDS.alert_fit)).select("doc_id", "fit_score", "recommendation")


@register(
    "alert_messages",
    f"""WITH {RANKED_CTE}, {identity_cte('ranked')} SELECT canonical_key, '[Listings] Immediate alert: ' || company_name || ' - ' || title AS subject,
        array_to_string([company_name || ' | ' || title, 'Location: ' || coalesce(location_text, 'Unknown'), 'Fit: ' || fit_score, 'Difficulty: ' || difficulty_score,
            'Apply: ' || apply_url, '', {_FIT_SENTENCE}, {_HARD_SENTENCE}], chr(10)) AS body
    FROM identified WHERE lifecycle_state IN ('new', 'reopened') AND fit_score >= {THRESHOLDS.alert_fit} AND recommendation IN ('apply_now', 'apply_if_interested')""",
)
def alert_messages(spark, sf_dir):
    return digest.alerts(ranked(spark, sf_dir), THRESHOLDS)


@register(
    "score_labels",
    f"""WITH {RANKED_CTE} SELECT doc_id,
        CASE WHEN fit_score >= 80 THEN 'Excellent' WHEN fit_score >= 70 THEN 'Strong' WHEN fit_score >= 60 THEN 'Good' ELSE 'Possible' END AS match_label,
        CASE WHEN difficulty_score >= 70 THEN 'Very high' WHEN difficulty_score >= 55 THEN 'High' WHEN difficulty_score >= 40 THEN 'Moderate' ELSE 'Typical' END AS competition,
        CASE recommendation WHEN 'apply_now' THEN 'Apply soon' WHEN 'apply_if_interested' THEN 'Worth applying' WHEN 'low_priority' THEN 'Optional' ELSE 'Skip' END AS advice
    FROM ranked""",
)
def score_labels(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "doc_id",
        digest.match_label(F.col("fit_score")).alias("match_label"),
        digest.competition_label(F.col("difficulty_score")).alias("competition"),
        digest.recommendation_text(F.col("recommendation")).alias("advice"),
    )


_DAYS = f"greatest(0, ({AS_OF_EPOCH} - first_epoch) // {DAY})"


@register(
    "cross_run_texts",
    f"""WITH {RANKED_CTE} SELECT doc_id, CASE WHEN lifecycle_state = 'new' THEN '' ELSE
        'first seen ' || {_DAYS} || CASE WHEN {_DAYS} = 1 THEN ' day ago' ELSE ' days ago' END
        || CASE WHEN prev_fit_score IS NULL THEN '' ELSE ' | prev fit ' || prev_fit_score || ' (' || CASE WHEN fit_score >= prev_fit_score THEN '+' ELSE '' END || (fit_score - prev_fit_score) || ')' END
        || CASE WHEN lifecycle_state = 'reopened' THEN ' | reopened' ELSE '' END END AS history FROM ranked""",
)
def cross_run_texts(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", digest.cross_run_text(AS_OF).alias("history"))


@register(
    "application_briefs",
    f"""WITH {RANKED_CTE} SELECT doc_id, 'Prepare an application to ' || company_name || ' - ' || title
        || '. Internships to name: Intern at Acme; Intern at Example. Skills to show: '
        || CASE WHEN len(owned) = 0 THEN 'core software skills' ELSE array_to_string(owned, ', ') END
        || '. Skills to explain or leave out: '
        || CASE WHEN len(unowned) = 0 THEN 'none' ELSE array_to_string(unowned, ', ') END
        || '. Close with a project that reached its users.' AS brief FROM ranked""",
)
def application_briefs(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", digest.application_brief(PROFILE).alias("brief"))


_DATE = "CASE WHEN posted_epoch IS NULL THEN 'date not listed' ELSE strftime(make_timestamp(posted_epoch * 1000000), '%b %-d') END"


@register(
    "listing_headers",
    f"WITH {RANKED_CTE} SELECT doc_id, '- ' || company_name || ' - ' || title || chr(10) || '  ' || coalesce(location_text, 'Location not listed') "
    f"|| ' | Posted ' || {_DATE} AS header FROM ranked",
)
def listing_headers(spark, sf_dir):
    text = F.substring_index(digest.listing_text(AS_OF), "\n", 2)
    return ranked(spark, sf_dir).select("doc_id", text.alias("header"))


def _two_sentences(why: str, default: str) -> str:
    parts = f"list_transform(string_split(CASE WHEN {why} = '' THEN '{default}' ELSE {why} END, '; ')[1:2], lambda p: upper(p[1]) || p[2:] || '.')"
    return f"array_to_string({parts}, ' ')"


@register(
    "listing_blocks",
    f"""WITH facts AS ({text_queries.QUERIES['detail_items'][1]}), l AS ({QUERIES['score_labels'][1]}),
    c AS ({QUERIES['cross_run_texts'][1]}), h AS ({QUERIES['listing_headers'][1]}),
    s AS (WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, fit_score, difficulty_score, apply_url, owned, {_two_sentences('fit_why', 'limited overlap with target profile')} AS fit_text,
        {_two_sentences('hard_why', '')} AS hard_text FROM scored)
    SELECT doc_id, items, h.header || chr(10) || '  Recommendation: ' || advice || chr(10) || '  Match: ' || match_label || ' (' || fit_score || '/100) | Competition: '
        || competition || ' (' || difficulty_score || '/100)' || chr(10) || '  Why it fits: ' || fit_text || chr(10) || '  Keep in mind: ' || hard_text || chr(10)
        || '  Matching experience: ' || CASE WHEN len(owned) = 0 THEN 'general software engineering experience' ELSE array_to_string(owned[1:5], ', ') END
        || CASE WHEN items <> '' THEN chr(10) || '  Details: ' || items ELSE '' END || chr(10) || '  Apply: ' || apply_url
        || CASE WHEN history <> '' THEN chr(10) || '  Cross-analysis: ' || history ELSE '' END AS block
    FROM s JOIN facts USING (doc_id) JOIN l USING (doc_id) JOIN c USING (doc_id) JOIN h USING (doc_id)""",
)
def listing_blocks(spark, sf_dir):
    return ranked(spark, sf_dir).select(
        "doc_id",
        digest.listing_text(AS_OF).alias("block"),
        F.array_join(detail_items(F.col("job_details")), " | ").alias("items"),
    )


@register(
    "ranked_counts",
    f"WITH {RANKED_CTE} SELECT count(*) FILTER (lifecycle_state = 'new') AS total_new, "
    "count(*) FILTER (lifecycle_state = 'reopened') AS total_reopened, "
    f"count(*) FILTER (fit_score >= {THRESHOLDS.high_signal_fit}) AS total_high_signal FROM ranked",
)
def ranked_counts(spark, sf_dir):
    from feedloom.operators.health import run_stats

    return run_stats(ranked(spark, sf_dir), THRESHOLDS)


@register(
    "fresh_actionable",
    f"WITH {RANKED_CTE} SELECT doc_id, lifecycle_state FROM ranked WHERE lifecycle_state IN ('new', 'reopened') "
    f"AND (posted_epoch IS NULL OR posted_epoch >= {AS_OF_EPOCH} - 7 * {DAY})",
)
def fresh_actionable(spark, sf_dir):
    return ranking.actionable(ranked(spark, sf_dir), AS_OF, rules.Limits()).select("doc_id", "lifecycle_state")


_SPARSE = (
    f"WITH {LISTINGS_CTE}, {identity_cte()} SELECT doc_id, canonical_key FROM identified "
    "WHERE length(trim(description_text, chr(32)||chr(10)||chr(9)||chr(13))) < 400"
)


@register(
    "enrichment_picks",
    f"{_SPARSE} ORDER BY {sql_any('lower(title)', rules.ENRICH_TITLE_WORDS)} DESC, posted_epoch IS NOT NULL DESC, posted_epoch DESC, source_ordinal, position LIMIT 30",
)
def enrichment_picks(spark, sf_dir):
    """The 30 sparse listings that are enriched first."""
    from feedloom.operators.enrichment import pick_sparse

    limits = rules.Limits(min_description_chars=400, max_enrichments=30)
    return pick_sparse(normalized(spark, sf_dir), limits).select("doc_id", "canonical_key")


@register("enrichment_all", _SPARSE)
def enrichment_all(spark, sf_dir):
    """All sparse listings, as without a limit."""
    from feedloom.operators.enrichment import pick_sparse

    return pick_sparse(normalized(spark, sf_dir), rules.Limits(min_description_chars=400)).select("doc_id", "canonical_key")


@register(
    "digest_subjects",
    f"""WITH {RANKED_CTE}, c AS (SELECT least({THRESHOLDS.max_digest_jobs}, count(*)) AS n FROM ranked WHERE {_ELIGIBLE})
    SELECT 'r1' AS run_id, CAST(n AS INT) AS job_count, CASE WHEN n = 0 THEN '[Listings] No strong new matches - Feb 10'
        ELSE '[Listings] ' || n || ' job' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' worth a look - Feb 10' END AS subject FROM c""",
)
def digest_subjects(spark, sf_dir):
    from pyspark.sql.window import Window

    jobs = ranked(spark, sf_dir)
    order = Window.partitionBy("run_id").orderBy(*digest.digest_order(_TIE))
    placed = digest.top_matches(jobs, THRESHOLDS, _TIE).withColumn("place", F.row_number().over(order))
    run = spark.range(1).select(F.lit("r1").alias("run_id"))
    none = spark.createDataFrame([], "run_id string, source_name string, message string")
    stats = run.withColumns({"total_collected": F.lit(0), "total_new": F.lit(0)})
    settings = rules.Settings(thresholds=THRESHOLDS, send_empty_digest=True)
    return digest.render_digest(run, placed, none, stats, AS_OF, settings).select("run_id", "job_count", "subject")
