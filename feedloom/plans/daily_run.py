"""One daily run from landed payloads to digest, with tables on shared storage between the stages.

Stages hand over through written tables, so a lost executor costs tasks and not a stage, and
nothing is computed twice. The new state becomes current only after the digest is written: a run
that dies in between is repeated in full and no listing is lost to "seen".
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom import rules
from feedloom.operators import dedupe, digest, enrichment, feedback, health, lifecycle, normalize, ranking, state, store
from feedloom.schemas import ERRORS_DDL
from feedloom.sources import boards, company_pages, html, markdown, outcomes, search, structured

ATS_COLLECTOR = "ats"
PAGES_COLLECTOR, SEARCH_COLLECTOR = "company_pages", "web_search"


@dataclass
class Inputs:
    """Landed tables of one run; any of them may be left out.

    ``company_pages`` (slug, url, html, source_ordinal, fetched_at) are read for the companies of the scan list, and
    ``found_payloads`` for the boards that they link to. ``search_results`` are rows of
    ``search.results_from_payloads``, ``search_pages`` (page_id, url, html) the pages landed for them.
    """

    structured: list[tuple[rules.StructuredFeed, DataFrame]] = field(default_factory=list)
    markdown: DataFrame | None = None
    boards: DataFrame | None = None
    board_payloads: DataFrame | None = None
    collected: list[DataFrame] = field(default_factory=list)
    pages: DataFrame | None = None
    companies: DataFrame | None = None
    company_pages: DataFrame | None = None
    found_payloads: DataFrame | None = None
    search_results: DataFrame | None = None
    search_pages: DataFrame | None = None
    decisions: DataFrame | None = None


FOUND_PAYLOADS_DDL = """
    source_ordinal int, platform string, identifier string, api_url string, careers_url string, fetched_at timestamp, body string
"""


def _feed_parts(inputs: Inputs, settings: rules.Settings, as_of: str, land):
    """Listings and outcome of every structured and Markdown feed; ``land`` writes a table of the run and reads it back.

    Payloads are parsed when they are landed; listings and outcomes both read the result.
    """
    listings, counts = [], []
    parts = [structured.parsed_payloads(payloads, feed).withColumn("feed", F.lit(feed.name)) for feed, payloads in inputs.structured]
    parsed = land(_union(parts), "parsed_feeds") if parts else None
    for feed, _ in inputs.structured:
        own = parsed.filter(F.col("feed") == feed.name)
        listings.append(
            structured.collect_feed(structured.map_json_rows(structured.parsed_rows(own), feed), settings, as_of).withColumn(
                "collector", F.lit(f"structured:{feed.name}")
            )
        )
        counts.append(
            own.agg(
                F.lit(feed.name).alias("source_name"),
                F.lit("structured").alias("kind"),
                (F.count(F.lit(1)) > 0).alias("landed"),
                F.coalesce(F.bool_and("readable"), F.lit(False)).alias("readable"),
                F.coalesce(F.sum(F.coalesce(F.size("raws"), F.lit(0))), F.lit(0)).alias("total_available"),
            )
        )
    if inputs.markdown is not None:
        rows = land(markdown.table_rows(markdown.table_lines(inputs.markdown)), "markdown_rows")
        listings.append(
            markdown.collect_rows(rows, settings, as_of).withColumn(
                "collector", F.concat(F.lit("markdown:"), "source_name")
            )
        )
        available = rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("total_available"))
        counts.append(
            inputs.markdown.select("source_name")
            .distinct()
            .join(available, "source_name", "left")
            .select(
                "source_name",
                F.lit("markdown").alias("kind"),
                F.lit(True).alias("landed"),
                F.lit(True).alias("readable"),
                F.coalesce("total_available", F.lit(0)).alias("total_available"),
            )
        )
    return listings, counts


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def run(
    spark: SparkSession,
    inputs: Inputs,
    root: str,
    run_id: str,
    as_of: str,
    settings: rules.Settings | None = None,
    scorer: ranking.Scorer | None = None,
) -> dict:
    """Run all stages; returns the run's counts. Tables are below ``root``."""
    settings = settings or rules.Settings()
    ledger = f"{root}/runs"
    store.append_ledger(store.ledger_entry(spark, run_id, "started", as_of), ledger, run_id, 0)
    try:
        stats = _run(spark, inputs, root, run_id, as_of, settings, scorer)
    except Exception as error:
        failed = store.ledger_entry(spark, run_id, "failed", as_of, error=str(error))
        store.append_ledger(failed, ledger, run_id, 1)
        raise
    done = store.ledger_entry(spark, run_id, "completed", as_of, stats)
    store.append_ledger(done, ledger, run_id, 1)
    return stats


def _collect(spark, inputs, root, run_id, as_of, settings):
    listings, counts = _feed_parts(
        inputs, settings, as_of, lambda df, name: store.append_run(df, f"{root}/{name}", run_id).drop("run_id")
    )
    outcome_parts = []
    if inputs.board_payloads is not None:
        # Postings are judged once; listings and outcomes both read the result.
        judged = store.append_run(boards.judged_postings(inputs.board_payloads, settings.filters), f"{root}/judged", run_id)
        listings.append(boards.collect_boards(judged).withColumn("collector", F.lit(ATS_COLLECTOR)))
        outcome_parts.append(
            outcomes.board_outcomes(inputs.boards, judged).withColumn("kind", F.lit("ats"))
        )
    if inputs.company_pages is not None:
        payloads = inputs.found_payloads
        if payloads is None:
            payloads = spark.createDataFrame([], FOUND_PAYLOADS_DDL)
        found, states = company_pages.collect(
            inputs.companies, inputs.company_pages, payloads, settings,
            lambda df, name: store.append_run(df, f"{root}/{name}", run_id).drop("run_id"),
        )
        listings.append(found.withColumn("collector", F.lit(PAGES_COLLECTOR)))
        outcome_parts.append(states)
    if inputs.search_results is not None:
        landed = inputs.search_pages
        if landed is None:
            landed = spark.createDataFrame([], "page_id bigint, url string, html string")
        read = html.page_facts(search.needed_pages(inputs.search_results, landed))
        facts = store.append_run(read, f"{root}/search_facts", run_id).drop("run_id")
        found = search.search_listings(inputs.search_results, facts, settings.filters, settings.limits.max_search_results)
        listings.append(found.withColumn("collector", F.lit(SEARCH_COLLECTOR)))
    for extra in inputs.collected:
        listings.append(extra.withColumn("collector", F.col("source_type")))
    collected, cap = _union(listings), settings.limits.max_jobs_per_source
    if cap is not None:
        store.append_run(outcomes.left_out(collected, "collector", cap), f"{root}/left_out", run_id)
    capped = outcomes.cap_per_collector(collected, "collector", cap)
    landed = store.raw_rows(capped).withColumn("raw_job_id", normalize.raw_job_id(run_id))
    raw = store.append_run(landed, f"{root}/raw", run_id)
    if counts:
        relevant = raw.groupBy("source_name").agg(F.count(F.lit(1)).alias("relevant_jobs"))
        feeds = _union(counts)
        outcome_parts.append(
            outcomes.feed_outcomes(
                feeds.select("source_name", "landed", "readable"),
                feeds.select("source_name", "total_available"),
                relevant,
            ).join(feeds.select("source_name", "kind"), "source_name")
        )
    return raw, (_union(outcome_parts) if outcome_parts else None)


def _watch_health(spark, found, root, run_id):
    """Mark stale sources, write the outcome table and return the findings."""
    runs = store.read_runs(spark, f"{root}/runs").filter(F.col("run_id") != run_id)
    stale = health.stale_now(found, store.read_health(spark, f"{root}/health"), runs)
    marked = health.mark_stale(found, stale)
    now = store.append_run(marked, f"{root}/health", run_id)
    stale_rows = now.filter(F.col("status") == outcomes.STALE)
    findings = (
        outcomes.source_errors(now)
        .unionByName(outcomes.empty_source_findings(now, now.select("source_name", "kind")))
        .unionByName(health.stale_findings(stale_rows))
    )
    store.append_run(findings, f"{root}/errors", run_id)


def _run(spark, inputs, root, run_id, as_of, settings, scorer) -> dict:
    state_root, buckets = f"{root}/state", settings.state_buckets
    state.compact_when_due(spark, state_root, buckets, settings.compact_after)
    raw, found = _collect(spark, inputs, root, run_id, as_of, settings)
    if found is not None:
        _watch_health(spark, found, root, run_id)
    else:
        store.append_run(spark.createDataFrame([], ERRORS_DDL), f"{root}/errors", run_id)

    unique = dedupe.merge_duplicates(normalize.normalize(raw.drop("run_id", "payload_json", "raw_description_hash", "collector")))
    index = state.alias_index(spark, state_root)
    matched = store.append_run(lifecycle.match_state(unique, index=index), f"{root}/unique", run_id).drop("run_id")
    # From here on only the stored rows that the batch or a decision means are used.
    keys = [matched.select(F.col("state_key").alias(state.KEY))]
    if inputs.decisions is not None:
        valid, refused = lifecycle.split_decisions(inputs.decisions)
        store.append_run(refused, f"{root}/decisions_refused", run_id)
        keys.append(valid)
    known = store.append_run(state.rows_of(spark, state_root, state.union_keys(*keys)), f"{root}/known", run_id).drop("run_id")
    if inputs.decisions is not None:
        store.append_run(lifecycle.decision_history(known, inputs.decisions), f"{root}/status_user", run_id)
        known = lifecycle.apply_decisions(known, inputs.decisions)
    if inputs.pages is not None:
        picked = enrichment.pick_sparse(lifecycle.new_candidates(matched, known), settings.limits)
        texts = enrichment.found_descriptions(picked, inputs.pages)
        matched = enrichment.patch_descriptions(matched, texts, settings.limits)
    if inputs.companies is not None:
        matched = lifecycle.with_company_id(matched, inputs.companies)
    else:
        matched = matched.withColumn("company_id", F.lit(None).cast("bigint"))

    version = state.next_version(spark, state_root)
    merged = lifecycle.merge_state(matched, known, as_of, settings.limits.reopen_after_days)
    staged = state.stage(merged, state_root, version)
    store.append_run(lifecycle.status_history(staged, as_of), f"{root}/status", run_id)

    scores_path = f"{root}/scores"
    history = store.read_scores(spark, scores_path)
    before = state.rows(spark, state_root)
    if inputs.decisions is not None:
        before = lifecycle.apply_decisions(before, inputs.decisions)
    learned = feedback.feedback_weights(feedback.observations(before, history), settings.limits.feedback_min_samples)
    weights = store.append_run(learned, f"{root}/weights", run_id).drop("run_id")
    if inputs.companies is not None:
        tiers = ranking.company_tiers(inputs.companies, settings.priority_companies)
    else:
        tiers = spark.createDataFrame(
            [(c.lower(), 1) for c in settings.priority_companies], "_name string, company_tier int"
        )
    wanted = ranking.actionable(staged, as_of, settings.limits)
    ranked = ranking.rank(wanted, tiers, weights, history, run_id, settings, scorer)
    ranked = store.append_run(ranked, f"{root}/ranked", run_id)
    store.append_run(store.score_rows(ranked, as_of), scores_path, run_id)
    store.append_run(digest.alerts(ranked, settings.thresholds, settings.subject_prefix), f"{root}/alerts", run_id)

    errors = store.read_run(spark, f"{root}/errors", run_id, ERRORS_DDL.removeprefix("run_id string, "))
    counted = (
        ranked.groupBy(F.lit(run_id).alias("run_id"))
        .agg(
            F.count_if(F.col("lifecycle_state") == rules.NEW).alias("total_new"),
            F.count_if(F.col("lifecycle_state") == rules.REOPENED).alias("total_reopened"),
            F.count_if(F.col("fit_score") >= settings.thresholds.high_signal_fit).alias("total_high_signal"),
        )
    )
    landed = raw.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_collected"))
    this_run = spark.range(1).select(F.lit(run_id).alias("run_id"))
    stats = this_run.join(landed, "run_id", "left").join(counted, "run_id", "left")
    cut = digest.top_matches(ranked, settings.thresholds, ["source_ordinal", "position"])
    # The cut holds at most max_digest_jobs rows; numbering them needs no more than one task.
    placed = cut.withColumn(
        "place",
        F.row_number().over(Window.partitionBy("run_id").orderBy(*digest.digest_order(["source_ordinal", "position"]))),
    )
    rendered = digest.render_digest(this_run, placed, errors, stats, as_of, settings)
    store.append_run(rendered, f"{root}/digests", run_id)

    counts = stats.select("total_collected", "total_new", "total_reopened", "total_high_signal").first().asDict()
    counts = {name: int(value or 0) for name, value in counts.items()}
    counts["total_normalized"] = counts["total_collected"]
    counts["total_errors"] = errors.count()
    state.publish(spark, state_root, version, run_id=run_id)
    if version == 0:
        # The first load becomes the base at once; should that fail, the next run does it.
        state.compact(spark, state_root, buckets)
    return counts


def read_state(spark: SparkSession, root: str) -> DataFrame:
    return state.rows(spark, f"{root}/state")
