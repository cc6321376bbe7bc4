"""Registered queries: duplicates, state merge, decisions, feedback, health and history."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.urls import canonical_key
from feedloom.operators import dedupe, feedback, health, lifecycle, ranking, state, store
from feedloom.plans import daily_run
from feedloom.plans.scoring_queries import PROFILE, scored, scored_cte, tiers  # noqa: F401
from feedloom.plans.testbed import (
    AS_OF,
    AS_OF_EPOCH,
    DAY,
    HEALTH_CTE,
    LISTINGS_CTE,
    RUNS_CTE,
    collected,
    companies,
    health_rows,
    identity_cte,
    normalized,
    runs,
    scratch,
    sql_any,
    table,
)
from feedloom.runtime import land
from feedloom.schemas import STATE_DDL, select_collected
from feedloom.sources import outcomes

QUERIES = {}
STRIP = "trim(description_text, chr(32)||chr(10)||chr(9)||chr(13))"


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = (query, sql)
        return query

    return keep


# --- duplicates ------------------------------------------------------------------------------

HASHED_CTE = f"""hashed AS (SELECT * EXCLUDE (description_text), {STRIP} AS description_text,
    sha256(CASE WHEN {STRIP} <> '' THEN {STRIP} ELSE title END) AS description_hash,
    sha256(company_name || '::' || title || '::' || coalesce(location_text, '') || '::' || {STRIP} || '::' || apply_url) AS content_hash
    FROM identified)"""
MERGED_CTE = f"""{LISTINGS_CTE}, {identity_cte()}, {HASHED_CTE}, merged AS (
    SELECT canonical_key, arg_min(struct_pack(doc_id, title, company_name, source_name, apply_url, location_text, source_ordinal, position),
               struct_pack(source_ordinal, position)) AS first,
           arg_max(struct_pack(description_text, description_hash, content_hash), struct_pack(n := length(description_text), a := -source_ordinal, b := -position)) AS longest,
           max(confidence) AS confidence, count(*) AS n, list_sort(list_distinct(list(source_name))) AS sources,
           arg_max('r1-' || doc_id, struct_pack(source_ordinal, position)) AS raw_job_id
    FROM hashed GROUP BY canonical_key)"""


@register(
    "merged_duplicates",
    f"""WITH {MERGED_CTE} SELECT canonical_key, first.doc_id AS doc_id, first.title AS title, confidence, n - 1 AS duplicates,
        md5(longest.description_text) AS text_digest, longest.content_hash AS content_hash, raw_job_id,
        CASE WHEN n > 1 THEN array_to_string(sources, ',') END AS seen_in_sources FROM merged""",
)
def merged_duplicates(spark, sf_dir):
    merged = dedupe.merge_duplicates(normalized(spark, sf_dir))
    return merged.select(
        "canonical_key",
        "doc_id",
        "title",
        "confidence",
        "duplicates",
        F.md5("description_text").alias("text_digest"),
        "content_hash",
        "raw_job_id",
        F.array_join("seen_in_sources", ",").alias("seen_in_sources"),
    )


@register(
    "duplicate_totals",
    f"WITH {MERGED_CTE} SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM merged",
)
def duplicate_totals(spark, sf_dir):
    return dedupe.duplicate_count(normalized(spark, sf_dir))


@register(
    "duplicate_documents",
    "SELECT sha256(text) AS text_key, min(doc_id) AS first_doc, count(*) - 1 AS duplicates, "
    "CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(list(source))), ',') END AS seen_in_sources FROM documents GROUP BY sha256(text)",
)
def duplicate_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("text_key"),
        "doc_id",
        F.lit(0).alias("source_ordinal"),
        F.col("doc_id").alias("position"),
        F.col("source").alias("source_name"),
        F.lit("").alias("description_text"),
        F.lit("").alias("description_hash"),
        F.lit("").alias("content_hash"),
        F.lit(1.0).alias("confidence"),
    )
    merged = dedupe.merge_duplicates(docs, "text_key")
    return merged.select(
        "text_key", F.col("doc_id").alias("first_doc"), "duplicates", F.array_join("seen_in_sources", ",").alias("seen_in_sources")
    )


@register("listings_per_source", f"WITH {LISTINGS_CTE} SELECT source_name, count(*) AS listings FROM listings GROUP BY source_name")
def listings_per_source(spark, sf_dir):
    return dedupe.source_counts(collected(spark, sf_dir))


@register("last_raw_ids", f"WITH {MERGED_CTE} SELECT canonical_key, raw_job_id FROM merged")
def last_raw_ids(spark, sf_dir):
    return dedupe.last_raw_ids(normalized(spark, sf_dir))


@register(
    "capped_listings",
    f"WITH {LISTINGS_CTE}, c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ats' ELSE source_name END AS collector, "
    "row_number() OVER (PARTITION BY CASE WHEN doc_id % 3 = 0 THEN 'ats' ELSE source_name END ORDER BY source_ordinal, position) AS rn FROM listings) "
    "SELECT doc_id, collector FROM c WHERE rn <= 20",
)
def capped_listings(spark, sf_dir):
    rows = collected(spark, sf_dir).withColumn(
        "collector", F.when(F.col("doc_id") % 3 == 0, "ats").otherwise(F.col("source_name"))
    )
    return outcomes.cap_per_collector(rows, "collector", 20).select("doc_id", "collector")


@register(
    "raw_hashes",
    f"WITH {LISTINGS_CTE} SELECT doc_id, sha256(trim(CASE WHEN description_text <> '' THEN description_text ELSE title END, "
    "chr(32)||chr(10)||chr(9)||chr(13))) AS raw_description_hash FROM listings",
)
def raw_hashes(spark, sf_dir):
    return store.raw_rows(collected(spark, sf_dir)).select("doc_id", "raw_description_hash")


# --- state -----------------------------------------------------------------------------------
# The state holds the listings with doc_id % 5 < 3 as an earlier run stored them; the batch holds
# those with doc_id % 5 > 0. Rows with doc_id % 11 = 0 were stored under an old kind of key.

_STORED = "doc_id % 5 < 3"
_BATCH = "doc_id % 5 > 0"
_SEEN_EPOCH = f"{AS_OF_EPOCH} - (doc_id % 12) * {DAY}"
_FIRST_EPOCH = f"{AS_OF_EPOCH} - (doc_id % 12 + 20) * {DAY}"
_STATUS = "CASE doc_id % 7 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' WHEN 2 THEN 'ignored' WHEN 3 THEN 'new' ELSE 'seen' END"


def stored_state(spark, sf_dir):
    """State of an earlier run at rest: derived from the merged listings, written and read back."""
    path = scratch(spark, "stored")
    _derived_state(spark, sf_dir).write.parquet(path)
    return spark.read.schema(STATE_DDL).parquet(path)


def _derived_state(spark, sf_dir):
    merged = dedupe.merge_duplicates(normalized(spark, sf_dir).filter(_STORED))
    legacy = F.concat(F.lit("legacy-"), F.col("doc_id").cast("string"))
    key = F.when(F.col("doc_id") % 11 == 0, legacy).otherwise(F.col("canonical_key"))
    columns = {
        "job_id": F.concat(F.lit("job-"), F.col("doc_id").cast("string")),
        "canonical_key": key,
        "company_id": F.lit(None).cast("bigint"),
        "content_hash": F.when(F.col("doc_id") % 2 == 0, F.lit("old")).otherwise(F.col("content_hash")),
        "current_status": F.expr(_STATUS),
        "application_status": F.expr(f"CASE WHEN doc_id % 7 < 3 THEN {_STATUS} END"),
        "applied_at": F.lit(None).cast("timestamp"),
        "application_notes": F.expr("CASE WHEN doc_id % 7 = 0 THEN 'kept' END"),
        "application_url": F.lit(None).cast("string"),
        "reopened_count": F.expr("CAST(doc_id % 2 AS INT)"),
        "first_seen_at": F.expr(f"timestamp_seconds({_FIRST_EPOCH})"),
        "last_seen_at": F.expr(f"timestamp_seconds({_SEEN_EPOCH})"),
        "metadata": F.create_map(F.lit("feed"), F.lit("stored"), F.lit("old"), F.lit("1")),
    }
    names = [f.split()[0] for f in _fields(STATE_DDL)]
    return merged.select(*[columns[n].alias(n) if n in columns else F.col(n) for n in names])


def _fields(ddl):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl).fieldNames()


def batch(spark, sf_dir):
    return dedupe.merge_duplicates(normalized(spark, sf_dir).filter(_BATCH))


def matched(spark, sf_dir):
    state = stored_state(spark, sf_dir)
    return lifecycle.match_state(batch(spark, sf_dir), state), state


def next_state(spark, sf_dir):
    rows, state = matched(spark, sf_dir)
    return lifecycle.merge_state(lifecycle.with_company_id(rows, companies(spark, sf_dir)), state, AS_OF)


def _merged_of(name: str, condition: str) -> str:
    return f"""{name}_rows AS (SELECT * FROM hashed WHERE {condition}), {name} AS (
        SELECT canonical_key, arg_min(struct_pack(doc_id, title, company_name, source_name, apply_url), struct_pack(source_ordinal, position)) AS first,
            arg_max(content_hash, struct_pack(n := length(description_text), a := -source_ordinal, b := -position)) AS content_hash,
            max(confidence) AS confidence, count(*) AS n, list_sort(list_distinct(list(source_name))) AS sources,
            arg_max('r1-' || doc_id, struct_pack(source_ordinal, position)) AS raw_job_id
        FROM {name}_rows GROUP BY canonical_key)"""


STATE_CTE = f"""{LISTINGS_CTE}, {identity_cte()}, {HASHED_CTE}, {_merged_of('stored0', _STORED)}, {_merged_of('batch', _BATCH)},
    stored AS (SELECT canonical_key AS today_key, CASE WHEN first.doc_id % 11 = 0 THEN 'legacy-' || first.doc_id ELSE canonical_key END AS state_key,
        'job-' || first.doc_id AS job_id, first.doc_id AS doc_id, first.source_name AS source_name, first.title AS title, first.company_name AS company_name,
        CASE WHEN n > 1 THEN sources ELSE [] END AS sources, first.apply_url AS apply_url, confidence,
        CASE WHEN first.doc_id % 2 = 0 THEN 'old' ELSE content_hash END AS content_hash, first.doc_id % 2 AS reopened_count,
        {_STATUS.replace('doc_id', 'first.doc_id')} AS current_status,
        {_SEEN_EPOCH.replace('doc_id', 'first.doc_id')} AS last_epoch, {_FIRST_EPOCH.replace('doc_id', 'first.doc_id')} AS first_epoch FROM stored0),
    matched AS (SELECT b.*, coalesce(e.state_key, l.state_key, b.canonical_key) AS state_key
        FROM batch b LEFT JOIN stored e ON e.state_key = b.canonical_key
        LEFT JOIN stored l ON l.today_key = b.canonical_key AND l.state_key <> l.today_key),
    joined AS (SELECT coalesce(m.state_key, s.state_key) AS k, m.canonical_key IS NOT NULL AS touched, s.job_id IS NOT NULL AS known, m.first AS mf, m.content_hash AS m_hash,
        m.n AS m_n, m.sources AS m_sources, m.raw_job_id AS m_raw, m.confidence AS m_conf, s.*
        FROM matched m FULL OUTER JOIN stored s ON s.state_key = m.state_key),
    lived AS (SELECT *, current_status IN ('saved', 'applied', 'ignored') AS managed,
        CASE WHEN NOT touched THEN NULL WHEN NOT known THEN 'new'
             WHEN current_status NOT IN ('saved', 'applied', 'ignored') AND {AS_OF_EPOCH} - last_epoch >= 7 * {DAY} AND content_hash <> m_hash THEN 'reopened'
             ELSE 'seen' END AS lifecycle_state FROM joined)"""


@register("matched_listings", f"WITH {STATE_CTE} SELECT canonical_key, state_key FROM matched")
def matched_listings(spark, sf_dir):
    return matched(spark, sf_dir)[0].select("canonical_key", "state_key")


@register(
    "new_candidates",
    f"WITH {STATE_CTE} SELECT canonical_key FROM matched WHERE state_key NOT IN (SELECT state_key FROM stored)",
)
def new_candidates(spark, sf_dir):
    rows, state = matched(spark, sf_dir)
    return lifecycle.new_candidates(rows, state).select("canonical_key")


@register(
    "merged_state",
    f"""WITH {STATE_CTE} SELECT k AS canonical_key, coalesce(job_id, k) AS job_id, lifecycle_state,
        CASE WHEN NOT touched OR (managed AND known) THEN current_status ELSE lifecycle_state END AS current_status,
        CASE WHEN touched THEN m_hash ELSE content_hash END AS content_hash, CASE WHEN touched THEN mf.title ELSE title END AS title,
        CASE WHEN touched THEN m_conf ELSE confidence END AS confidence,
        CAST(coalesce(reopened_count, 0) + CASE WHEN lifecycle_state = 'reopened' THEN 1 ELSE 0 END AS INT) AS reopened_count,
        CAST(coalesce(first_epoch, {AS_OF_EPOCH}) AS BIGINT) AS first_seen, CAST(CASE WHEN touched THEN {AS_OF_EPOCH} ELSE last_epoch END AS BIGINT) AS last_seen,
        s.s_suppkey AS company_id,
        CASE WHEN NOT known THEN CASE WHEN m_n > 1 THEN array_to_string(m_sources, ',') END
             WHEN NOT touched THEN CASE WHEN len(sources) > 0 THEN array_to_string(sources, ',') END
             ELSE array_to_string(list_sort(list_distinct(list_concat(list_concat(sources, CASE WHEN m_n > 1 THEN m_sources ELSE [] END), [source_name, mf.source_name]))), ',') END AS seen_in_sources,
        CASE WHEN NOT known THEN mf.source_name WHEN NOT touched THEN 'stored' ELSE mf.source_name END AS feed,
        CASE WHEN known THEN '1' END AS old_mark
    FROM lived LEFT JOIN supplier s ON touched AND lower(s.s_name) = lower(mf.company_name)""",
)
def merged_state(spark, sf_dir):
    merged = next_state(spark, sf_dir)
    return _merged_columns(merged, "lifecycle_state")


def _merged_columns(merged, *more):
    return merged.select(
        "canonical_key",
        "job_id",
        *more,
        "current_status",
        "content_hash",
        "title",
        "confidence",
        "reopened_count",
        F.unix_seconds("first_seen_at").alias("first_seen"),
        F.unix_seconds("last_seen_at").alias("last_seen"),
        "company_id",
        F.array_join("seen_in_sources", ",").alias("seen_in_sources"),
        F.col("metadata")["feed"].alias("feed"),
        F.col("metadata")["old"].alias("old_mark"),
    )


# --- state at rest: base, deltas, alias index ------------------------------------------------


def _state_at_rest(spark, sf_dir) -> str:
    """The stored state in the layout of the daily run, in parts.

    A third of the rows is right in the base; the others are stale there and mended by one of two deltas, in the first of which
    a third of them has a wrong alias.
    """
    root, rows = scratch(spark, "state"), stored_state(spark, sf_dir)
    part = F.pmod(F.xxhash64("canonical_key"), F.lit(3))
    extra = {"lifecycle_state": F.lit(None).cast("string"), "source_ordinal": F.lit(0), "position": F.lit(0).cast("bigint")}
    rows = rows.withColumns({**extra, "today_key": canonical_key(F.col("apply_url")), "part": part})
    stale = rows.withColumns({"title": F.lit("stale"), "current_status": F.lit("new")})
    wrong = stale.withColumn("today_key", F.concat(F.lit("wrong-"), "canonical_key"))
    state.stage(rows.filter("part = 1").unionByName(stale.filter("part <> 1")), root, 0)
    state.publish(spark, root, 0)
    state.compact(spark, root, 8)
    for version, changed in ((2, rows.filter("part = 0").unionByName(wrong.filter("part = 2"))), (3, rows.filter("part = 2"))):
        state.stage(changed, root, version)
        state.publish(spark, root, version)
    return root


def _next_delta(spark, sf_dir) -> str:
    """The state at rest after the batch, which writes a delta of the rows it touches."""
    root = _state_at_rest(spark, sf_dir)
    rows = lifecycle.match_state(batch(spark, sf_dir), index=state.alias_index(spark, root))
    rows = land(lifecycle.with_company_id(rows, companies(spark, sf_dir)), "matched")
    known = state.rows_of(spark, root, state.union_keys(rows.select(F.col("state_key").alias("canonical_key"))))
    state.stage(lifecycle.merge_state(rows, known, AS_OF), root, 4)
    state.publish(spark, root, 4)
    return root


_WHOLE = QUERIES["merged_state"][1]


@register("delta_state", f"SELECT * EXCLUDE (lifecycle_state) FROM ({_WHOLE})")
def delta_state(spark, sf_dir):
    """``merged_state`` read from a base and the deltas of three runs."""
    return _merged_columns(state.rows(spark, _next_delta(spark, sf_dir)))


@register("compacted_state", f"SELECT * EXCLUDE (lifecycle_state) FROM ({_WHOLE})")
def compacted_state(spark, sf_dir):
    """The same after compaction."""
    root = _next_delta(spark, sf_dir)
    state.compact(spark, root, 8)
    return _merged_columns(state.rows(spark, root))


@register("indexed_matches", QUERIES["matched_listings"][1])
def indexed_matches(spark, sf_dir):
    """``matched_listings`` by the maintained alias index."""
    index = state.alias_index(spark, _state_at_rest(spark, sf_dir))
    return lifecycle.match_state(batch(spark, sf_dir), index=index).select("canonical_key", "state_key")


def _two_runs(spark, sf_dir) -> str:
    """The daily run twice on a fresh root: some listings, then, a day later, some of these and others."""
    root = scratch(spark, "daily")
    rows = collected(spark, sf_dir)
    small = rules.Settings(state_buckets=8)
    for run_id, as_of, part in (("r1", "2024-01-29 00:00:00", _STORED), ("r2", "2024-01-30 00:00:00", _BATCH)):
        inputs = daily_run.Inputs(collected=[select_collected(rows.filter(part))], companies=companies(spark, sf_dir))
        daily_run.run(spark, inputs, root, run_id, as_of, small)
    return root


@register(
    "daily_run_state",
    f"""WITH {STATE_CTE} SELECT coalesce(b.canonical_key, s.canonical_key) AS canonical_key, coalesce(b.first.title, s.first.title) AS title,
        CASE WHEN b.canonical_key IS NOT NULL AND s.canonical_key IS NOT NULL THEN 'seen' ELSE 'new' END AS current_status,
        coalesce(b.content_hash, s.content_hash) AS content_hash
    FROM stored0 s FULL OUTER JOIN batch b ON s.canonical_key = b.canonical_key""",
)
def daily_run_state(spark, sf_dir):
    """The state after two daily runs."""
    rows = daily_run.read_state(spark, _two_runs(spark, sf_dir))
    return rows.select("canonical_key", "title", "current_status", "content_hash")


@register(
    "daily_run_ledger",
    f"""SELECT run_id, 'completed' AS status, CAST(n AS BIGINT) AS total_collected, CAST(0 AS BIGINT) AS total_errors
    FROM (SELECT 'r1' AS run_id, count(*) AS n FROM documents WHERE {_STORED} UNION ALL SELECT 'r2', count(*) FROM documents WHERE {_BATCH})""",
)
def daily_run_ledger(spark, sf_dir):
    """What the ledger holds after two daily runs."""
    runs_ = store.read_runs(spark, f"{_two_runs(spark, sf_dir)}/runs")
    return runs_.select("run_id", "status", "total_collected", "total_errors")


@register(
    "status_history",
    f"WITH {STATE_CTE} SELECT coalesce(job_id, k) AS job_id, lifecycle_state AS status, {AS_OF_EPOCH} AS changed FROM lived WHERE lifecycle_state IN ('new', 'reopened')",
)
def status_history(spark, sf_dir):
    rows = lifecycle.status_history(next_state(spark, sf_dir), AS_OF)
    return rows.select("job_id", "status", F.unix_seconds("changed_at").alias("changed"))


@register(
    "company_ids",
    f"WITH {LISTINGS_CTE} SELECT doc_id, s_suppkey AS company_id FROM listings LEFT JOIN supplier ON lower(s_name) = lower(company_name)",
)
def company_ids(spark, sf_dir):
    rows = collected(spark, sf_dir).withColumn("canonical_key", F.col("doc_id").cast("string"))
    return lifecycle.with_company_id(rows, companies(spark, sf_dir)).select("doc_id", "company_id")


@register(
    "company_tiers",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, CAST(tier AS INT) AS company_tier FROM sc0",
)
def company_tiers(spark, sf_dir):
    return ranking.with_tier(collected(spark, sf_dir), tiers(spark, sf_dir), "doc_id").select("doc_id", "company_tier")


@register(
    "recently_seen",
    "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS seen FROM events ORDER BY ts DESC, event_id LIMIT 100",
)
def recently_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.format_string("%012d", "event_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("last_seen_at")
    )
    return health.recently_seen(rows).select("event_id", F.unix_micros("last_seen_at").alias("seen"))


# --- decisions -------------------------------------------------------------------------------
# Orders stand for listings, events for decisions on them: user_id picks the listing.


def _tracked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("canonical_key"),
        F.concat(F.lit("j"), F.col("c_custkey").cast("string")).alias("job_id"),
        F.concat(F.lit("https://x.example/"), F.col("c_custkey").cast("string")).alias("apply_url"),
        F.lit("seen").alias("current_status"),
        F.lit(None).cast("string").alias("application_status"),
        F.when(F.col("c_custkey") % 2 == 0, "before").alias("application_notes"),
        F.lit(None).cast("timestamp").alias("applied_at"),
        F.lit(None).cast("string").alias("application_url"),
    )


_DECISION = "CASE event_type WHEN 'signup' THEN 'saved' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'ignored' ELSE event_type END"
_NOTES = "CASE WHEN event_id % 3 = 0 THEN 'note ' || event_id WHEN event_id % 3 = 1 THEN '' END"


def _decisions(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("decision_id"),
        F.col("user_id").cast("string").alias("canonical_key"),
        F.expr(_DECISION).alias("status"),
        F.expr(_NOTES).alias("notes"),
        F.col("ts").cast("timestamp").alias("decided_at"),
    )


@register(
    "applied_decisions",
    f"""WITH d AS (SELECT event_id, CAST(user_id AS VARCHAR) AS k, {_DECISION} AS status, {_NOTES} AS notes, ts FROM events),
    v AS (SELECT * FROM d WHERE status IN ('saved', 'applied', 'ignored')),
    n AS (SELECT k, arg_max(status, struct_pack(ts, event_id)) AS status, arg_max(notes, struct_pack(ts, event_id)) FILTER (notes <> '') AS notes,
          max(ts) FILTER (status = 'applied') AS applied_at FROM v GROUP BY k)
    SELECT CAST(c_custkey AS VARCHAR) AS canonical_key, coalesce(n.status, 'seen') AS current_status, n.status AS application_status,
        coalesce(n.notes, CASE WHEN c_custkey % 2 = 0 THEN 'before' END) AS application_notes, CAST(epoch_us(applied_at) AS BIGINT) AS applied,
        CASE WHEN applied_at IS NOT NULL THEN 'https://x.example/' || c_custkey END AS application_url
    FROM customer LEFT JOIN n ON n.k = CAST(c_custkey AS VARCHAR)""",
)
def applied_decisions(spark, sf_dir):
    after = lifecycle.apply_decisions(_tracked(spark, sf_dir), _decisions(spark, sf_dir))
    return after.select(
        "canonical_key",
        "current_status",
        "application_status",
        "application_notes",
        F.unix_micros("applied_at").alias("applied"),
        "application_url",
    )


@register(
    "decision_history",
    f"SELECT 'j' || user_id AS job_id, {_DECISION} AS status, CAST(epoch_us(ts) AS BIGINT) AS changed, {_NOTES} AS notes FROM events "
    "JOIN customer ON c_custkey = user_id WHERE event_type IN ('signup', 'purchase', 'error')",
)
def decision_history(spark, sf_dir):
    rows = lifecycle.decision_history(_tracked(spark, sf_dir), _decisions(spark, sf_dir))
    return rows.select("job_id", "status", F.unix_micros("changed_at").alias("changed"), "notes")


@register(
    "refused_decisions",
    f"SELECT event_id AS decision_id, {_DECISION} AS status FROM events WHERE event_type NOT IN ('signup', 'purchase', 'error')",
)
def refused_decisions(spark, sf_dir):
    return lifecycle.split_decisions(_decisions(spark, sf_dir))[1].select("decision_id", "status")


# --- feedback --------------------------------------------------------------------------------
# labels decide: quality 1 saves a document's listing, quality 0 ignores it.

DECIDED_CTE = f"""{LISTINGS_CTE}, {scored_cte()}, decided AS (
    SELECT s.*, CASE WHEN l.quality = 1 THEN 1 ELSE -1 END AS sign FROM scored s JOIN labels l USING (doc_id)),
    keyed AS (
        SELECT DISTINCT doc_id, sign, 'company' AS dimension, lower(company_name) AS key FROM decided
        UNION SELECT DISTINCT doc_id, sign, 'tag', unnest(tags) FROM decided
        UNION SELECT DISTINCT doc_id, sign, 'skill', unnest(owned) FROM decided
        UNION SELECT DISTINCT doc_id, sign, 'work_mode', mode FROM (SELECT doc_id, sign, {{mode}} AS mode FROM decided) WHERE mode <> 'Not specified'),
    weights AS (SELECT dimension, key, CAST(sum(sign) AS BIGINT) AS weight FROM keyed GROUP BY 1, 2)"""
_MODE = (
    f"CASE WHEN is_remote OR {sql_any('x', rules.REMOTE_TEXT_WORDS)} THEN 'Remote' WHEN contains(x, 'hybrid') THEN 'Hybrid' "
    f"WHEN {sql_any('x', rules.ONSITE_WORDS)} THEN 'On-site' ELSE 'Not specified' END"
)
DECIDED_CTE = DECIDED_CTE.replace("{mode}", _MODE)


def _scored_table(spark, sf_dir):
    """Scored listings at rest, as the run leaves them for the next one."""
    path = scratch(spark, "scored")
    rows = scored(spark, sf_dir).drop("fit_groups", "difficulty_groups", "normalized_url", "primary_identity", "content_hash")
    rows.withColumn("job_id", F.col("doc_id").cast("string")).write.parquet(path)
    return spark.read.parquet(path)


def _weights(spark, sf_dir, rows):
    scores = rows.select(
        "job_id", F.lit("r1").alias("run_id"), F.lit(AS_OF).cast("timestamp").alias("created_at"), "tags", "top_matching_skills"
    )
    decided = rows.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn(
        "current_status", F.when(F.col("quality") == 1, "saved").otherwise("ignored")
    )
    path = scratch(spark, "weights")
    feedback.feedback_weights(feedback.observations(decided, scores)).write.parquet(path)
    return spark.read.parquet(path)


@register("feedback_weights", f"WITH {DECIDED_CTE} SELECT * FROM weights")
def feedback_weights(spark, sf_dir):
    return _weights(spark, sf_dir, _scored_table(spark, sf_dir))


@register(
    "feedback_scores",
    f"""WITH {DECIDED_CTE}, all_keys AS (
        SELECT doc_id, 'company' AS dimension, lower(company_name) AS key, 2 AS f FROM scored
        UNION ALL SELECT doc_id, 'tag', unnest(tags), 1 FROM scored
        UNION ALL SELECT doc_id, 'skill', unnest(owned), 1 FROM scored
        UNION ALL SELECT doc_id, 'work_mode', {_MODE}, 1 FROM scored),
    adj AS (SELECT doc_id, CAST(greatest(-10, least(10, sum(weight * f))) AS INT) AS adjustment FROM all_keys JOIN weights USING (dimension, key) GROUP BY doc_id)
    SELECT doc_id, CAST(greatest(0, least(100, fit_score + coalesce(adjustment, 0))) AS INT) AS fit_score,
        CASE WHEN coalesce(adjustment, 0) = 0 THEN recommendation
             WHEN {sql_any('lower(title || chr(32) || ' + STRIP + ')', rules.MISMATCH_WORDS)} THEN 'skip'
             WHEN fit_score + adjustment >= 80 THEN 'apply_now' WHEN fit_score + adjustment >= 65 THEN 'apply_if_interested'
             WHEN fit_score + adjustment >= 45 THEN 'low_priority' ELSE 'skip' END AS recommendation,
        array_to_string(list_sort(CASE WHEN coalesce(adjustment, 0) = 0 THEN tags ELSE list_concat(tags, ['feedback_adjusted']) END), ',') AS tags
    FROM scored LEFT JOIN adj USING (doc_id)""",
)
def feedback_scores(spark, sf_dir):
    stored = _scored_table(spark, sf_dir)
    rows = feedback.apply_feedback(stored, _weights(spark, sf_dir, stored), "doc_id")
    return rows.select("doc_id", "fit_score", "recommendation", F.array_join("tags", ",").alias("tags"))


# --- scores over runs ------------------------------------------------------------------------


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("run_id"),
        F.col("user_id").cast("string").alias("job_id"),
        F.floor(F.col("value") % 101).cast("int").alias("fit_score"),
        (F.col("event_id") % 101).cast("int").alias("difficulty_score"),
        F.struct(F.col("ts").cast("timestamp").alias("t"), "event_id").alias("created_at"),
    )


@register(
    "latest_scores",
    "SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(arg_max(floor(value % 101), struct_pack(ts, event_id)) AS INT) AS fit_score, "
    "arg_max(event_id, struct_pack(ts, event_id)) AS event_id FROM events GROUP BY 1",
)
def latest_scores(spark, sf_dir):
    return feedback.latest_scores(_scores(spark, sf_dir)).select("job_id", "fit_score", "created_at.event_id")


@register(
    "previous_scores",
    "SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(arg_max(floor(value % 101), struct_pack(ts, event_id)) AS INT) AS prev_fit_score "
    "FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-30' GROUP BY 1",
)
def previous_scores(spark, sf_dir):
    return ranking.previous_scores(_scores(spark, sf_dir), "2024-01-30")


@register(
    "digest_candidates",
    "SELECT CAST(user_id AS VARCHAR) AS job_id, c_name, CAST(floor(value % 101) AS INT) AS fit_score, 'seen' AS lifecycle_state "
    "FROM events JOIN customer ON c_custkey = user_id WHERE CAST(ts AS DATE) = DATE '2024-01-15'",
)
def digest_candidates(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), "c_name", F.lit("seen").alias("current_status")
    )
    return ranking.digest_rows(jobs, _scores(spark, sf_dir), "2024-01-15").select("job_id", "c_name", "fit_score", "lifecycle_state")


_EXTERNAL = "doc_id % 3 = 1"


def _external(spark, sf_dir):
    """Scores as an outside scorer would land them; some are out of bounds."""
    return table(spark, sf_dir, "documents").filter(_EXTERNAL).select(
        "doc_id",
        (F.col("doc_id") % 120).cast("int").alias("fit_score"),
        F.lit(40).alias("difficulty_score"),
        F.lit("apply_now").alias("recommendation"),
        F.lit("Good\x07 – fit").alias("fit_summary"),
        F.lit("Hard").alias("difficulty_summary"),
        F.array(F.lit("Python")).alias("top_matching_skills"),
        F.array().cast("array<string>").alias("missing_or_weaker_skills"),
        F.array(F.lit("external")).alias("tags"),
        F.lit(0.9).alias("scorer_confidence"),
    )


@register(
    "external_scores",
    f"""WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, CAST(CASE WHEN {_EXTERNAL} AND doc_id % 120 <= 100 THEN doc_id % 120 ELSE fit_score END AS INT) AS fit_score,
        CASE WHEN {_EXTERNAL} AND doc_id % 120 <= 100 THEN 'external' ELSE 'heuristic' END AS scorer,
        CASE WHEN {_EXTERNAL} AND doc_id % 120 <= 100 THEN 'external' ELSE array_to_string(tags, ',') END AS tags FROM scored""",
)
def external_scores(spark, sf_dir):
    merged = ranking.merge_external(scored(spark, sf_dir), _external(spark, sf_dir), job_key="doc_id")
    return merged.select("doc_id", "fit_score", "scorer", F.array_join("tags", ",").alias("tags"))


@register(
    "external_candidates",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, fit_score FROM scored WHERE fit_score >= 50",
)
def external_candidates(spark, sf_dir):
    return ranking.external_candidates(scored(spark, sf_dir), rules.Limits()).select("doc_id", "fit_score")


def _example_scorer(rows: pd.DataFrame) -> pd.DataFrame:
    """A scorer that breaks on some rows and exceeds the bounds on others."""
    if (rows["doc_id"] % 7 == 3).any():
        raise ValueError("this batch holds a row that cannot be scored")
    odd = rows["doc_id"] % 5 == 2
    texts = {"recommendation": "apply_now", "fit_summary": "Good fit", "difficulty_summary": "Hard"}
    out = rows[["canonical_key"]].assign(fit_score=(rows["doc_id"] % 101).mask(odd, 300), difficulty_score=40, scorer_confidence=0.9, **texts)
    return out.assign(**{c: [["external"]] * len(out) for c in ("top_matching_skills", "missing_or_weaker_skills", "tags")})


def _called(spark, sf_dir):
    """Scored listings, the candidates among them, and what the example scorer returns for these."""
    # The scores are read by the candidates, the scorer's join and the outcomes; texts are read by none of these.
    rows = scored(spark, sf_dir).drop("description_text", "job_details", "fit_groups", "difficulty_groups")
    rows = land(rows.withColumn("canonical_key", F.col("doc_id").cast("string")), "scored")
    candidates = ranking.external_candidates(rows, rules.Limits()).select("canonical_key", "doc_id")
    return rows, candidates, ranking.external_scores(candidates, _example_scorer)


_TAKEN = "fit_score >= 50 AND doc_id % 7 <> 3 AND doc_id % 5 <> 2"


@register(
    "external_scorer",
    f"""WITH {LISTINGS_CTE}, {scored_cte()} SELECT doc_id, CAST(CASE WHEN {_TAKEN} THEN doc_id % 101 ELSE fit_score END AS INT) AS fit_score,
        CASE WHEN {_TAKEN} THEN 'external' ELSE 'heuristic' END AS scorer FROM scored""",
)
def external_scorer(spark, sf_dir):
    rows, _, found = _called(spark, sf_dir)
    return ranking.merge_external(rows, found).select("doc_id", "fit_score", "scorer")


@register(
    "external_outcomes",
    f"""WITH {LISTINGS_CTE}, {scored_cte()} SELECT CASE WHEN doc_id % 7 = 3 THEN 'failed' WHEN doc_id % 5 = 2 THEN 'refused' ELSE 'scored' END AS outcome,
        count(*) AS n FROM scored WHERE fit_score >= 50 GROUP BY 1""",
)
def external_outcomes(spark, sf_dir):
    _, candidates, found = _called(spark, sf_dir)
    return ranking.external_outcomes(candidates, found)


# --- runs and source health ------------------------------------------------------------------


@register(
    "recent_runs",
    f"WITH {RUNS_CTE} SELECT run_id FROM runs WHERE status = 'completed' ORDER BY started_at DESC LIMIT 14",
)
def recent_runs(spark, sf_dir):
    return health.recent_completed_runs(runs(spark, sf_dir), 14).select("run_id")


_SEQ_CTE = "seq AS (SELECT run_id, row_number() OVER (ORDER BY started_at) AS n FROM runs WHERE status = 'completed')"


@register(
    "stale_history",
    f"""WITH {RUNS_CTE}, {HEALTH_CTE}, {_SEQ_CTE}, srcs AS (SELECT DISTINCT source_name FROM health),
    grid AS (SELECT n, seq.run_id, srcs.source_name, h.status, h.total_available FROM seq CROSS JOIN srcs
             LEFT JOIN health h ON h.run_id = seq.run_id AND h.source_name = srcs.source_name),
    lagged AS (SELECT *, lag(total_available, 1) OVER w AS p1, lag(total_available, 2) OVER w AS p2 FROM grid WINDOW w AS (PARTITION BY source_name ORDER BY n))
    SELECT run_id, source_name FROM lagged WHERE status = 'healthy' AND total_available = 0 AND p1 = 0 AND p2 = 0""",
)
def stale_history(spark, sf_dir):
    return health.stale_history(health_rows(spark, sf_dir), runs(spark, sf_dir))


@register(
    "stale_now",
    f"""WITH {RUNS_CTE}, {HEALTH_CTE}, last2 AS (SELECT run_id FROM runs WHERE status = 'completed' AND run_id <> '2024-01-30' ORDER BY started_at DESC LIMIT 2)
    SELECT source_name, CASE WHEN status = 'healthy' AND total_available = 0
        AND (SELECT count(*) FROM health p JOIN last2 USING (run_id) WHERE p.source_name = h.source_name AND p.total_available = 0) = 2 THEN 'stale' ELSE status END AS status
    FROM health h WHERE run_id = '2024-01-30'""",
)
def stale_now(spark, sf_dir):
    rows = health_rows(spark, sf_dir)
    current = rows.filter("run_id = '2024-01-30'")
    earlier = runs(spark, sf_dir).filter("run_id <> '2024-01-30'")
    marked = health.mark_stale(current, health.stale_now(current, rows.filter("run_id <> '2024-01-30'"), earlier))
    return marked.select("source_name", "status")


@register(
    "problem_sources",
    f"""WITH {RUNS_CTE}, {HEALTH_CTE}, last AS (SELECT run_id FROM runs WHERE status = 'completed' ORDER BY started_at DESC LIMIT 1),
    h AS (SELECT health.* FROM health JOIN last USING (run_id)),
    c AS (SELECT run_id, count(*) AS sources_checked, count(*) FILTER (status = 'failed') AS need_attention FROM h GROUP BY run_id)
    SELECT c.*, source_name FROM c LEFT JOIN (SELECT run_id, source_name FROM h WHERE status = 'failed') b USING (run_id)""",
)
def problem_sources(spark, sf_dir):
    return health.problem_sources(health_rows(spark, sf_dir), runs(spark, sf_dir))


@register(
    "empty_source_findings",
    f"WITH {HEALTH_CTE} SELECT source_name, 'health' AS stage FROM health WHERE run_id = '2024-01-20' AND total_available = 0 AND CAST(source_name AS BIGINT) % 3 < 2",
)
def empty_source_findings(spark, sf_dir):
    now = health_rows(spark, sf_dir).filter("run_id = '2024-01-20'")
    number = F.col("source_name").cast("bigint") % 3
    kinds = now.select("source_name", F.when(number == 0, "structured").when(number == 1, "markdown").otherwise("ats").alias("kind"))
    return outcomes.empty_source_findings(now, kinds).select("source_name", "stage")


@register(
    "covered_dates",
    f"WITH {RUNS_CTE} SELECT CAST(CAST((started_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS VARCHAR) AS local_date, "
    "count(*) AS completed_runs FROM runs WHERE status = 'completed' GROUP BY 1",
)
def covered_dates(spark, sf_dir):
    rows = health.covered_dates(runs(spark, sf_dir), "America/New_York")
    return rows.withColumn("local_date", F.col("local_date").cast("string"))


@register(
    "uncovered_dates",
    f"""WITH {RUNS_CTE}, l AS (SELECT CAST((started_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS d, status FROM runs)
    SELECT CAST(g AS DATE)::VARCHAR AS local_date FROM (SELECT unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY)) AS g FROM l)
    WHERE CAST(g AS DATE) NOT IN (SELECT d FROM l WHERE status = 'completed')""",
)
def uncovered_dates(spark, sf_dir):
    rows = health.uncovered_dates(runs(spark, sf_dir), "America/New_York")
    return rows.select(F.col("local_date").cast("string").alias("local_date"))


@register(
    "run_due",
    f"""WITH {RUNS_CTE}, last5 AS (SELECT started_at FROM runs WHERE status = 'completed' ORDER BY started_at DESC LIMIT 5)
    SELECT count(*) FILTER (CAST((started_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) = DATE '2024-01-30') = 0 AS run_due FROM last5""",
)
def run_due(spark, sf_dir):
    return health.should_run(runs(spark, sf_dir), "America/New_York", "2024-01-30 13:00:00")


# --- dimensions and retention ----------------------------------------------------------------


@register(
    "upserted_companies",
    "SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' Inc' ELSE s_name END AS name, "
    "CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_suppkey % 4 + 1 END AS INT) AS priority_tier, 'slug-' || s_suppkey AS slug FROM supplier "
    "UNION ALL SELECT NULL, n_name, 2, 'nation-' || n_nationkey FROM nation",
)
def upserted_companies(spark, sf_dir):
    current = companies(spark, sf_dir).select("company_id", "slug", "name", "priority_tier")
    changed = current.filter("company_id % 3 = 0").select(
        "slug", F.concat("name", F.lit(" Inc")).alias("name"), F.lit(1).alias("priority_tier")
    )
    added = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("slug"),
        F.col("n_name").alias("name"),
        F.lit(2).alias("priority_tier"),
    )
    return store.upsert_dimension(current, changed.unionByName(added), "slug")


@register(
    "retained_keys",
    """WITH s AS (SELECT event_type AS scope, CAST(event_id AS VARCHAR) AS key, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS n FROM events)
    SELECT scope, key FROM s WHERE n <= 500""",
)
def retained_keys(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("scope"),
        F.col("event_id").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("first_seen_at"),
    )
    return store.retain_latest(seen, 500).select("scope", "key")


@register(
    "ledger_latest",
    f"WITH {RUNS_CTE} SELECT run_id, status FROM runs",
)
def ledger_latest(spark, sf_dir):
    """Ledger written as started and closing entries, read back as one row per run."""
    ledger = scratch(spark, "ledger")
    rows = runs(spark, sf_dir)
    blank = [F.lit(None).cast("bigint").alias(f"total_{n}") for n in ("collected", "normalized", "new", "reopened", "high_signal", "errors")]
    for number, status in ((0, F.lit("started")), (1, F.col("status"))):
        rows.select(
            "run_id", status.alias("status"), "started_at", F.col("started_at").alias("completed_at"), *blank,
            F.lit(None).cast("string").alias("error"), F.lit(number).alias("entry"),
        ).write.mode("append").partitionBy("run_id", "entry").parquet(ledger)
    return store.read_runs(spark, ledger).select("run_id", "status")


@register(
    "score_history",
    f"WITH {LISTINGS_CTE}, {scored_cte()} SELECT 'run-1' AS run_id, doc_id, fit_score, recommendation FROM scored",
)
def score_history(spark, sf_dir):
    """Score rows appended twice for the same run and read back once."""
    path = scratch(spark, "scores")
    rows = scored(spark, sf_dir).withColumn("job_id", F.col("doc_id").cast("string"))
    rows = land(store.score_rows(rows, AS_OF), "score-rows")
    for _ in range(2):
        store.append_run(rows, path, "run-1")
    return store.read_scores(spark, path).select(
        "run_id", F.col("job_id").cast("bigint").alias("doc_id"), "fit_score", "recommendation"
    )


@register(
    "snapshot_state",
    f"WITH {STATE_CTE} SELECT state_key AS canonical_key, job_id, current_status FROM stored",
)
def snapshot_state(spark, sf_dir):
    """State written as a bucketed snapshot, published and read back through the pointer."""
    root = scratch(spark, "state")
    store.stage_snapshot(_derived_state(spark, sf_dir), root, 0, "canonical_key", 8)
    store.publish(spark, root, 0, buckets=8, key="canonical_key")
    return store.read_state(spark, root).select("canonical_key", "job_id", "current_status")
