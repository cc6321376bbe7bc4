"""The whole chain on literal payloads: two runs, decisions, reopening, health, failure."""

import json

import pytest
from pyspark.sql import functions as F

import helpers
from feedloom import rules
from feedloom.operators import store
from feedloom.plans import daily_run
from feedloom.sources import boards

FEED = rules.StructuredFeed(name="feed_a", url="https://feeds.example/new-grad.json", job_path="jobs")
SMALL = rules.Settings(filters=helpers.FILTERS, profile=helpers.PROFILE, state_buckets=4)
JOBS = [
    {
        "job_id": "fig-1",
        "company": "Figma",
        "title": "Software Engineer, New Grad 2027",
        "url": "https://boards.greenhouse.io/figma/jobs/12345",
        "location": "Remote, United States",
        "posted_at": "2026-08-20T12:00:00Z",
        "description": "Class of 2027 software engineer role building React, TypeScript, Node.js, Python, and APIs for a product team.",
    },
    {
        "job_id": "ex-1",
        "company": "Nooks",
        "title": "Software Engineer - New Grad",
        "url": "https://www.nooks.example/jobs/1?utm_source=a",
        "locations": ["ignored"],
        "location": ["San Francisco, CA", "New York, NY"],
        "posted_at": 1787184000,
    },
    {"company": "Gone", "title": "Software Engineer, New Grad", "url": "https://x.example/1", "active": False},
    {"company": "Text", "title": "Software Engineer, New Grad", "url": "https://x.example/2", "active": "false"},
    {"company": "Agg", "title": "Software Engineer, New Grad", "url": "https://www.linkedin.com/jobs/1"},
    {"company": "Old", "title": "Software Engineer, New Grad", "url": "https://x.example/3", "posted_at": "2026-01-01"},
    {"company": "SRE Inc", "title": "Site Reliability Engineer, New Grad", "url": "https://x.example/4"},
    {"title": "Software Engineer, New Grad", "url": "https://x.example/5"},
]
GREENHOUSE = {
    "jobs": [
        {
            "id": 12345,
            "title": "Software Engineer, New Grad 2027",
            "absolute_url": "https://boards.greenhouse.io/figma/jobs/12345?gh_src=abc",
            "updated_at": "2026-08-20T12:00:00Z",
            "location": {"name": "Remote, United States"},
            "content": "Class of 2027 new grad role building collaborative product experiences with React, "
            "TypeScript, Python and backend APIs in a software engineer team that ships product features.",
        }
    ]
}


def inputs(spark, jobs=JOBS, **more):
    body = json.dumps({"jobs": jobs})
    payload = spark.createDataFrame([(0, body)], "source_ordinal int, body string").withColumn(
        "fetched_at", F.lit("2026-08-21").cast("timestamp")
    )
    landed = spark.createDataFrame(
        [
            (10, "greenhouse", "Figma", "figma", "https://boards-api.greenhouse.io/v1/boards/figma/jobs", "", json.dumps(GREENHOUSE)),
            (11, "ashby", "Broken", "broken", "https://api.ashbyhq.com/b", "", '{"errors": [{"message": "down"}]}'),
        ],
        "source_ordinal int, platform string, company_name string, identifier string, api_url string, careers_url string, body string",
    ).withColumn("fetched_at", F.lit("2026-08-21").cast("timestamp"))
    listed = spark.createDataFrame(
        [("greenhouse:Figma", True), ("ashby:Broken", True), ("taleo:Other", False), ("lever:Silent", True)],
        "source_name string, supported boolean",
    )
    companies = spark.createDataFrame([(1, "figma", "Figma", 1), (2, "nooks", "Nooks", 3)], "company_id bigint, slug string, name string, priority_tier int")
    return daily_run.Inputs(structured=[(FEED, payload)], boards=listed, board_payloads=landed, companies=companies, **more)


def test_two_runs(spark, folder):
    first = daily_run.run(spark, inputs(spark), folder, "r1", "2026-08-21 08:00:00", SMALL)
    assert first["total_collected"] == 4 and first["total_new"] == 3
    state = {r.company_name: r for r in daily_run.read_state(spark, folder).collect()}
    assert set(state) == {"Figma", "Nooks", "Text"}
    figma = state["Figma"]
    assert figma.seen_in_sources == ["feed_a", "greenhouse:Figma"] and figma.company_id == 1
    assert "collaborative" in figma.description_text and figma.raw_job_id == "r1-10-0"
    assert figma.current_status == "new" and figma.is_remote
    assert state["Nooks"].location_text == "San Francisco, CA, New York, NY"
    assert str(state["Nooks"].posted_at) == "2026-08-20 00:00:00"

    health = {r.source_name: r for r in store.read_health(spark, f"{folder}/health").collect()}
    assert (health["feed_a"].status, health["feed_a"].total_available, health["feed_a"].relevant_jobs) == ("healthy", 8, 3)
    assert (health["greenhouse:Figma"].total_available, health["greenhouse:Figma"].relevant_jobs) == (1, 1)
    assert health["ashby:Broken"].status == "failed" and health["lever:Silent"].status == "failed"
    assert health["taleo:Other"].status == "unsupported" and health["taleo:Other"].total_available is None

    digest = spark.read.parquet(f"{folder}/digests").collect()
    assert len(digest) == 1
    assert digest[0].subject == "[Listings] 3 jobs worth a look - Aug 21"
    text = digest[0].body_text
    assert text.index("Best matches") < text.index("- Figma - Software Engineer, New Grad 2027") < text.index("Also worth a look")
    assert "  Remote, United States | Posted Aug 20" in text and "- Source issues: 2" in text
    assert "  Matching experience: Python, TypeScript, React" in text

    second = daily_run.run(spark, inputs(spark), folder, "r2", "2026-08-22 08:00:00", SMALL)
    assert second["total_new"] == 0 and second["total_reopened"] == 0
    assert spark.read.parquet(f"{folder}/digests").count() == 1
    assert {r.current_status for r in daily_run.read_state(spark, folder).collect()} == {"seen"}

    # A repeated run id replaces its rows instead of adding to them.
    runs = {r.run_id: r.status for r in store.read_runs(spark, f"{folder}/runs").collect()}
    assert runs == {"r1": "completed", "r2": "completed"}

    keys = {r.company_name: r.canonical_key for r in daily_run.read_state(spark, folder).collect()}
    decisions = spark.createDataFrame(
        [
            (1, keys["Figma"], "saved", "nice", "2026-08-23 00:00:00"),
            (2, keys["Figma"], "applied", "", "2026-08-24 00:00:00"),
            (3, keys["Text"], "archived", None, "2026-08-24 00:00:00"),
            (4, "unknown", "saved", None, "2026-08-24 00:00:00"),
        ],
        "decision_id bigint, canonical_key string, status string, notes string, decided_at string",
    ).withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    changed = [dict(j, title=j["title"] + " ") if j.get("company") != "Nooks" else dict(j, title="Software Engineer - New Grad (Web)") for j in JOBS]
    third = daily_run.run(
        spark, inputs(spark, changed, decisions=decisions), folder, "r3", "2026-08-29 08:00:00",
        rules.Settings(filters=helpers.FILTERS, profile=helpers.PROFILE, limits=rules.Limits(digest_max_age_days=30), state_buckets=4),
    )
    state = {r.company_name: r for r in daily_run.read_state(spark, folder).collect()}
    assert third["total_reopened"] == 1
    assert state["Nooks"].current_status == "reopened" and state["Nooks"].reopened_count == 1
    assert state["Figma"].current_status == "applied" and state["Figma"].application_notes == "nice"
    assert state["Figma"].application_url == state["Figma"].apply_url
    assert spark.read.parquet(f"{folder}/decisions_refused").count() == 1
    ranked = spark.read.parquet(f"{folder}/ranked").filter("run_id = 'r3'").collect()
    assert [r.prev_fit_score for r in ranked] == [65]
    body = spark.read.parquet(f"{folder}/digests").filter("run_id = 'r3'").first().body_text
    assert "first seen 8 days ago | prev fit 65 (+0) | reopened" in body


def test_state_side_is_not_shuffled(spark, folder):
    daily_run.run(spark, inputs(spark), folder, "r1", "2026-08-21 08:00:00", SMALL)
    state = daily_run.read_state(spark, folder)
    batch = spark.createDataFrame([("k", "v")], "canonical_key string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = batch.join(state, "canonical_key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_failed_run_leaves_state_unpublished(spark, folder):
    bad = inputs(spark)
    bad.companies = spark.createDataFrame([(1, "x")], "company_id bigint, wrong string")
    with pytest.raises(Exception):
        daily_run.run(spark, bad, folder, "r1", "2026-08-21 08:00:00", SMALL)
    assert store.read_runs(spark, f"{folder}/runs").first().status == "failed"
    assert store.read_pointer(spark, f"{folder}/state") is None
    again = daily_run.run(spark, inputs(spark), folder, "r2", "2026-08-21 09:00:00", SMALL)
    assert again["total_new"] == 3


def _only_feed(spark, jobs):
    body = json.dumps({"jobs": jobs})
    payload = spark.createDataFrame([(0, body)], "source_ordinal int, body string").withColumn(
        "fetched_at", F.lit("2026-08-21").cast("timestamp")
    )
    return daily_run.Inputs(structured=[(FEED, payload)])


@pytest.mark.parametrize("jobs, new", [(JOBS[:1], 1), ([dict(JOBS[0], posted_at="2026-07-20")], 0), ([], 0)])
def test_run_finishes_on_a_fresh_root(spark, folder, jobs, new):
    """A healthy feed without findings; nothing fresh enough to rank; an empty feed."""
    stats = daily_run.run(spark, _only_feed(spark, jobs), folder, "007", "2026-08-21 08:00:00", SMALL)
    assert (stats["total_new"], stats["total_collected"]) == (new, len(jobs))
    assert daily_run.read_state(spark, folder).count() == len(jobs)
    assert [(r.run_id, r.status) for r in store.read_runs(spark, f"{folder}/runs").collect()] == [("007", "completed")]
    again = daily_run.run(spark, _only_feed(spark, []), folder, "2026-08-22", "2026-08-22 08:00:00", SMALL)
    assert again["total_collected"] == 0 and daily_run.read_state(spark, folder).count() == len(jobs)


def test_repeated_run_replaces_its_rows_by_fewer(spark, folder):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    path = f"{folder}/history"
    assert store.append_run(rows, path, "manual 1/2").count() == 2
    store.append_run(rows, path, "007")
    assert store.append_run(rows.limit(0), path, "manual 1/2").columns == ["n", "s", "run_id"]
    kept = store.read_history(spark, path, "n int, s string, run_id string").collect()
    assert sorted((r.n, r.run_id) for r in kept) == [(1, "007"), (2, "007")]


def test_caps_are_off_and_counted_when_set(spark, folder):
    assert rules.Limits().max_jobs_per_source is None and rules.Limits().max_enrichments is None
    jobs = [dict(JOBS[0], job_id=f"j{i}", url=f"https://x.example/{i}") for i in range(5)]
    few = rules.Settings(filters=helpers.FILTERS, profile=helpers.PROFILE, limits=rules.Limits(max_jobs_per_source=2), state_buckets=4)
    assert daily_run.run(spark, _only_feed(spark, jobs), folder, "r1", "2026-08-21 08:00:00", few)["total_collected"] == 2
    left = spark.read.parquet(f"{folder}/left_out").collect()
    assert [(r.collector, r.listed, r.dropped) for r in left] == [("structured:feed_a", 5, 3)]


def test_platform_registry_is_complete():
    assert set(boards.PLATFORMS) == {"ashby", "gem", "greenhouse", "lever", "smartrecruiters", "workday"}


def company_inputs(spark):
    """Four companies: a board with a relevant job, a board without one, a page of its own, no page."""
    link = '<a href="/jobs/{0}">Software Engineer, New Grad {0}</a>'
    page = '<html><title>t</title>' + link
    landed = spark.createDataFrame(
        [
            ("figma", 0, "https://figma.example/careers", page.format(1) + " https://boards.greenhouse.io/Figma"),
            ("quiet", 1, "https://quiet.example/careers", page.format(2) + " https://jobs.lever.co/quiet https://jobs.ashbyhq.com/gone"),
            ("own", 2, "https://own.example/careers", page.format(3)),
            ("unasked", 3, "https://unasked.example/careers", page.format(4)),
        ],
        "slug string, source_ordinal int, url string, html string",
    ).withColumn("fetched_at", F.lit("2026-08-21").cast("timestamp"))
    companies = spark.createDataFrame(
        [(1, "figma", "Figma", 1, True), (2, "quiet", "Quiet", 1, True), (3, "own", "Own", 1, True), (4, "silent", "Silent", 2, True), (5, "unasked", "Unasked", 1, False)],
        "company_id bigint, slug string, name string, priority_tier int, enabled boolean",
    )
    senior = json.dumps([{"id": "9", "text": "Senior Accountant", "hostedUrl": "https://jobs.lever.co/quiet/9", "categories": {"location": "Remote, US"}}])
    payloads = spark.createDataFrame(
        [
            (0, "greenhouse", "figma", "https://boards-api.greenhouse.io/v1/boards/figma/jobs", "", json.dumps(GREENHOUSE)),
            (1, "lever", "quiet", "https://api.lever.co/quiet", "", senior),
            (2, "greenhouse", "unasked", "https://x.example", "", "not json: must not be read"),
        ],
        "source_ordinal int, platform string, identifier string, api_url string, careers_url string, body string",
    ).withColumn("fetched_at", F.lit("2026-08-21").cast("timestamp"))
    return dict(companies=companies, company_pages=landed, found_payloads=payloads)


def test_company_pages_and_search_in_the_run(spark, folder):
    results = spark.createDataFrame(
        [(0, "q", 0, "Nooks Software Engineer, New Grad", "https://jobs.lever.co/nooks/1", " s ", "engine"), (0, "q", 1, "Jobs", "https://acme.example/jobs", None, "engine")],
        "source_ordinal int, query string, position bigint, title string, url string, snippet string, source_name string",
    ).withColumn("published_at", F.lit(None).cast("timestamp"))
    page = '<html><title>Acme</title><a href="/jobs/7">Software Engineer, New Grad</a></html>'
    pages = spark.createDataFrame([(1, "https://acme.example/jobs", page), (2, "https://other.example", page)], "page_id bigint, url string, html string")
    given = daily_run.Inputs(search_results=results, search_pages=pages, **company_inputs(spark))
    stats = daily_run.run(spark, given, folder, "r1", "2026-08-21 08:00:00", SMALL)
    state = {r.apply_url: r for r in daily_run.read_state(spark, folder).collect()}
    assert {u: (r.source_name, r.company_name, r.company_id) for u, r in state.items()} == {
        "https://boards.greenhouse.io/figma/jobs/12345?gh_src=abc": ("greenhouse:Figma", "Figma", 1),
        "https://quiet.example/jobs/2": ("company:quiet", "Quiet", 2),
        "https://own.example/jobs/3": ("company:own", "Own", 3),
        "https://jobs.lever.co/nooks/1": ("search:engine", "Nooks", None),
        "https://acme.example/jobs/7": ("search:engine", "Acme", None),
    }
    assert stats["total_collected"] == 5 and stats["total_errors"] == 2
    health = {r.source_name: (r.status, r.total_available, r.relevant_jobs) for r in store.read_health(spark, f"{folder}/health").collect()}
    assert health == {
        "company:figma": ("healthy", None, 1),
        "company:quiet": ("healthy", None, 1),
        "company:own": ("healthy", None, 1),
        "company:silent": ("failed", None, 0),
        "discovered:greenhouse:Figma": ("healthy", 1, 1),
        "discovered:lever:Quiet": ("healthy", 1, 0),
        "discovered:ashby:Quiet": ("failed", None, 0),
    }


def test_company_pages_without_payloads_or_pages(spark, folder):
    given = company_inputs(spark)
    given["found_payloads"] = None
    daily_run.run(spark, daily_run.Inputs(**given), folder, "r1", "2026-08-21 08:00:00", SMALL)
    assert {r.source_name for r in daily_run.read_state(spark, folder).collect()} == {"company:figma", "company:quiet", "company:own"}


def test_skew_join_equals_a_plain_join(spark):
    from feedloom.runtime import skew_join

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(None, -1), (77, -2)], "k long, n long"))
    other = spark.range(120).select((F.col("id") % 60).alias("k"), F.col("id").alias("m")).unionByName(spark.createDataFrame([(None, 5)], "k long, m long"))
    for how in ("inner", "left"):
        got = skew_join(rows, other, ["k"], "n", how, per_salt=100).select("k", "n", "m")
        want = rows.join(other, "k", how).select("k", "n", "m")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
