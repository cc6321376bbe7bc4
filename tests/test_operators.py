"""Duplicates, lifecycle, scoring, feedback, digest and health on literal rows."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import helpers
from feedloom import rules, runtime
from feedloom.functions.scoring import score
from feedloom.operators import dedupe, digest, feedback, health, lifecycle, normalize, ranking, store, watch
from feedloom.schemas import STATE_DDL, select_collected

UUID = "622e1f1e-4a39-4e7c-8526-1189ca588066"


def listings(spark, rows):
    """Normalized rows from dictionaries, landed in the given order."""
    base = {"source_name": "s", "company_name": "Acme", "title": "Software Engineer New Grad", "location_text": "Remote", "description_text": "", "confidence": 1.0}
    filled = [{**base, **row, "source_ordinal": 0, "position": i} for i, row in enumerate(rows)]
    names = ["source_ordinal", "position", "source_name", "apply_url", "company_name", "title", "location_text", "description_text", "confidence"]
    frame = spark.createDataFrame(
        [tuple(r[n] for n in names) for r in filled],
        "source_ordinal int, position bigint, source_name string, apply_url string, company_name string, title string, "
        "location_text string, description_text string, confidence double",
    )
    landed = select_collected(frame, metadata=F.create_map(F.lit("feed"), F.col("source_name")))
    return normalize.normalize(landed.withColumn("raw_job_id", normalize.raw_job_id("r1")))


def test_duplicates(spark):
    rows = listings(
        spark,
        [
            {"source_name": "b", "apply_url": "https://boards.greenhouse.io/f/jobs/1", "description_text": "short", "confidence": 0.5},
            {"source_name": "a", "apply_url": "https://boards.greenhouse.io/f/jobs/1?gh_src=x", "description_text": "longer text", "confidence": 0.9},
            {"source_name": "c", "apply_url": "https://www.boards.greenhouse.io/f/jobs/1/", "description_text": "other  text", "confidence": 0.1},
            {"apply_url": "https://jobs.ashbyhq.com/netic/job-123/application?embed=true"},
            {"apply_url": "https://jobs.ashbyhq.com/netic/job-123"},
            {"apply_url": "https://www.ixl.com/company/jobs?gh_jid=8615710002"},
            {"apply_url": "https://www.ixl.com/company/jobs?gh_jid=8615717002"},
        ],
    )
    merged = {r.position: r for r in dedupe.merge_duplicates(rows).collect()}
    assert set(merged) == {0, 3, 5, 6}
    first = merged[0]
    assert first.source_name == "b" and first.description_text == "longer text" and first.confidence == 0.9
    assert first.seen_in_sources == ["a", "b", "c"] and first.duplicates == 2 and first.raw_job_id == "r1-0-2"
    assert merged[5].seen_in_sources is None
    assert dedupe.duplicate_count(rows).first().duplicates == 3


def test_hot_key_and_partition_count(spark):
    rows = [{"apply_url": f"https://x.org/{0 if i % 3 else i}", "source_name": f"s{i % 5}"} for i in range(90)]
    answers = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        merged = dedupe.merge_duplicates(listings(spark, rows))
        answers.append(sorted((r.canonical_key, r.position, r.duplicates, tuple(r.seen_in_sources or [])) for r in merged.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert answers[0] == answers[1] and max(a[2] for a in answers[0]) == 60


def as_state(spark, rows, **columns):
    names = [c.split()[0] for c in spark.createDataFrame([], STATE_DDL).columns]
    merged = dedupe.merge_duplicates(rows)
    base = {
        "job_id": F.col("canonical_key"), "company_id": F.lit(None), "current_status": F.lit("seen"), "application_status": F.lit(None),
        "applied_at": F.lit(None), "application_notes": F.lit(None), "application_url": F.lit(None), "reopened_count": F.lit(0),
        "first_seen_at": F.lit("2026-08-01").cast("timestamp"), "last_seen_at": F.lit("2026-08-14 08:00:00").cast("timestamp"), **columns,
    }
    types = {f.name: f.dataType for f in spark.createDataFrame([], STATE_DDL).schema}
    return merged.select(*[(base[n] if n in base else F.col(n)).cast(types[n]).alias(n) for n in names])


def test_legacy_alias_keeps_its_row(spark):
    old = listings(spark, [{"source_name": "feed_one", "apply_url": f"https://jobs.ashbyhq.com/faros-ai/{UUID}/application?embed=true"}])
    state = as_state(spark, old, canonical_key=F.lit("legacy-key"), job_id=F.lit("j1"))
    new = dedupe.merge_duplicates(listings(spark, [{"source_name": "feed_two", "apply_url": f"https://jobs.ashbyhq.com/faros-ai/{UUID}", "company_name": "Faros"}]))
    matched = lifecycle.match_state(new, state)
    assert lifecycle.new_candidates(matched, state).count() == 0
    rows = lifecycle.merge_state(matched.withColumn("company_id", F.lit(None).cast("bigint")), state, "2026-08-15 08:00:00").collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.job_id, row.canonical_key, row.lifecycle_state) == ("j1", "legacy-key", "seen")
    assert row.company_name == "Faros" and row.seen_in_sources == ["feed_one", "feed_two"]
    assert row.metadata["feed"] == "feed_two"


def test_exact_row_beats_alias_and_oldest_alias_wins(spark):
    url = "https://x.org/jobs/1"
    key = hashlib.sha256(b"url::https://x.org/jobs/1").hexdigest()
    state = as_state(spark, listings(spark, [{"apply_url": url}]))
    older = state.withColumns({"canonical_key": F.lit("old-b"), "job_id": F.lit("b"), "first_seen_at": F.lit("2025-01-02").cast("timestamp")})
    oldest = state.withColumns({"canonical_key": F.lit("old-a"), "job_id": F.lit("a"), "first_seen_at": F.lit("2025-01-01").cast("timestamp")})
    batch = dedupe.merge_duplicates(listings(spark, [{"apply_url": url + "/"}]))
    assert lifecycle.match_state(batch, state.unionByName(older)).first().state_key == key
    assert lifecycle.match_state(batch, older.unionByName(oldest)).first().state_key == "old-a"


@pytest.mark.parametrize(
    "status, as_of, title, life",
    [
        ("seen", "2026-08-21 08:00:00", "Changed", "reopened"),
        ("seen", "2026-08-21 07:59:59", "Changed", "seen"),
        ("seen", "2026-08-30 08:00:00", "Software Engineer New Grad", "seen"),
        ("applied", "2026-08-30 08:00:00", "Changed", "seen"),
    ],
)
def test_lifecycle(spark, status, as_of, title, life):
    url = "https://x.org/jobs/1"
    state = as_state(spark, listings(spark, [{"apply_url": url}]), current_status=F.lit(status))
    batch = dedupe.merge_duplicates(listings(spark, [{"apply_url": url, "title": title}]))
    matched = lifecycle.match_state(batch, state).withColumn("company_id", F.lit(None).cast("bigint"))
    row = lifecycle.merge_state(matched, state, as_of).first()
    assert row.lifecycle_state == life and row.reopened_count == (life == "reopened")
    assert row.current_status == (status if status == "applied" else life)
    assert str(row.last_seen_at) == as_of and str(row.first_seen_at) == "2026-08-01 00:00:00"


def ranked(spark, rows, tier=3):
    frame = listings(spark, rows).withColumn("company_tier", F.lit(tier))
    return score(frame, helpers.PROFILE)


def test_scoring_goldens(spark):
    figma = {
        "company_name": "Figma", "title": "Software Engineer, New Grad 2027", "location_text": "Remote, United States", "apply_url": "u1",
        "description_text": "Class of 2027 software engineer role building React, TypeScript, Node.js, Python, and APIs for a product team.",
    }
    row = ranked(spark, [figma], 1).first()
    assert (row.fit_score, row.difficulty_score, row.recommendation) == (81, 49, "apply_now")
    assert row.top_matching_skills == ["Python", "TypeScript", "React", "Node.js"]
    assert row.tags == ["backend", "new_grad", "priority_company", "remote"]
    assert row.fit_summary == (
        "Fit 81/100 — role type matches your target; explicitly targets new grads / class of 2027; strong skill overlap; "
        "product-focused engineering role; location matches your preference; no seniority red flags; priority company."
    )
    sparse = {"title": "Software Engineer - New Grad", "location_text": "San Francisco, CA", "apply_url": "u2", "company_name": "Nooks"}
    row = ranked(spark, [sparse]).first()
    assert (row.fit_score, row.difficulty_score, row.recommendation) == (65, 35, "apply_if_interested")
    assert row.fit_groups.explicit_entry_floor == 24
    sre = {"title": "Site Reliability Engineer, New Grad", "location_text": "New York, NY", "apply_url": "u3", "company_name": "Datadog",
           "description_text": "Own infrastructure, incidents, on-call, and SRE automation."}
    row = ranked(spark, [sre]).first()
    assert (row.fit_score, row.recommendation) == (0, "skip") and row.difficulty_groups.company_bar == 28


def test_seniority(spark):
    base = {"title": "Software Engineer I", "location_text": "New York, NY", "company_name": "Example", "apply_url": "u"}
    texts = [
        "Build backend APIs with Python and React under the guidance of senior engineers.",
        "Build backend APIs with Python and React under the guidance of experienced engineers.",
        "Build backend APIs with Python. Requires 5+ years of professional experience.",
        "Build backend APIs with Python. At least 2 years needed, 40 years of experience in total.",
    ]
    rows = {r.position: r for r in ranked(spark, [{**base, "description_text": t} for t in texts]).collect()}
    assert rows[0].fit_score == rows[1].fit_score
    assert rows[2].fit_groups.seniority_penalty == -35 and rows[2].fit_score < 60
    assert rows[3].fit_groups.seniority_penalty == -18


def test_feedback(spark):
    job = {"company_name": "Example", "title": "Full-Stack Software Engineer, New Grad 2027", "location_text": "Remote, United States",
           "description_text": "Build a full-stack Python product for customers.", "apply_url": "u"}
    rows = ranked(spark, [job])
    observed = spark.createDataFrame(
        [(f"j{i}", 1, "example", "Remote", ["full_stack", "full_stack"], ["Python"]) for i in range(3)] + [("j9", -1, "other", "Not specified", None, None)],
        "job_id string, sign int, company string, work_mode string, tags array<string>, top_matching_skills array<string>",
    )
    weights = feedback.feedback_weights(observed)
    found = {(r.dimension, r.key): r.weight for r in weights.collect()}
    assert found == {("company", "example"): 3, ("tag", "full_stack"): 3, ("skill", "Python"): 3, ("work_mode", "Remote"): 3, ("company", "other"): -1}
    before, after = rows.first(), feedback.apply_feedback(rows, weights).first()
    assert after.fit_score == min(100, before.fit_score + 10) and "feedback_adjusted" in after.tags
    assert feedback.feedback_weights(observed.limit(2)).count() == 0
    in_row = feedback.adjusted(rows, weights.filter("dimension <> 'work_mode'"), bound=100).first().adjustment
    joined = feedback.adjusted(rows, weights.filter("dimension <> 'work_mode'"), bound=100, max_catalog=1).first().adjustment
    assert in_row == joined == 12


def test_salted_lookup_equals_broadcast(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = spark.range(500).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    for how in ("left", "inner", "left_semi"):
        small = runtime.lookup_join(rows, lookup, ["k"], how, salt_by="id")
        large = runtime.lookup_join(rows, lookup, ["k"], how, salt_by="id", max_rows=10, salts=4)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_external_scorer_falls_back(spark):
    rows = ranked(spark, [{"apply_url": f"https://x.org/{i}", "title": "Software Engineer - New Grad", "company_name": f"c{i}"} for i in range(5)])

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        if len(batch) > 1 or batch["company_name"].iloc[0] == "c3":
            raise RuntimeError("provider failed")
        fit = 300 if batch["company_name"].iloc[0] == "c4" else 91
        return pd.DataFrame(
            {"canonical_key": batch["canonical_key"], "fit_score": fit, "difficulty_score": 10, "recommendation": "apply_now", "fit_summary": "a\x07b",
             "difficulty_summary": "", "top_matching_skills": [["Go"]], "missing_or_weaker_skills": [[]], "tags": [["t"]], "scorer_confidence": 0.9}
        )

    found = ranking.external_scores(ranking.external_candidates(rows, rules.Limits()), scorer)
    merged = {r.company_name: r for r in ranking.merge_external(rows, found).collect()}
    assert {n: r.scorer for n, r in merged.items()} == {"c0": "external", "c1": "external", "c2": "external", "c3": "heuristic", "c4": "heuristic"}
    assert merged["c0"].fit_score == 91 and merged["c0"].fit_summary == "a b" and merged["c3"].fit_score == 65


def test_external_batches_are_halved():
    calls = []

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        calls.append(len(batch))
        if (batch["canonical_key"] == "k41").any():
            raise RuntimeError("provider failed")
        again = pd.DataFrame({"canonical_key": [*batch["canonical_key"], batch["canonical_key"].iloc[0], "stranger"]})
        return again.assign(fit_score=90)

    rows = pd.DataFrame({"canonical_key": [f"k{i}" for i in range(64)]})
    found = pd.concat(ranking._halved(rows, scorer, "canonical_key"))
    assert sorted(found["canonical_key"]) == sorted(f"k{i}" for i in range(64) if i != 41)
    assert len(calls) == 13
    assert ranking._halved(rows.iloc[41:42], scorer, "canonical_key") == []


def digest_frame(spark):
    rows = [{"apply_url": f"https://example.com/{i}", "company_name": f"Company {i}"} for i in range(12)]
    frame = ranked(spark, rows)
    number = F.regexp_extract("company_name", r"(\d+)", 1).cast("int")
    return frame.withColumns(
        {
            "fit_score": 90 - number, "difficulty_score": F.lit(50), "recommendation": F.when(number == 2, "skip").otherwise("apply_now"),
            "lifecycle_state": F.when(number == 0, "seen").otherwise("new"), "first_seen_at": F.lit("2026-08-20").cast("timestamp"),
            "prev_fit_score": F.lit(None).cast("int"), "run_id": F.lit("r1"),
        }
    )


def test_digest_excludes_seen_and_caps(spark):
    top = digest.top_matches(digest_frame(spark), rules.Thresholds(digest_min_fit=55, max_digest_jobs=5), ["source_ordinal", "position"])
    assert [r.company_name for r in top.collect()] == ["Company 1", "Company 3", "Company 4", "Company 5", "Company 6"]
    assert digest_frame(spark).filter(digest.alert_filter(88)).count() == 1


def test_empty_digest(spark):
    run = spark.range(1).select(F.lit("r1").alias("run_id"))
    none = spark.createDataFrame([], "run_id string, source_name string, message string")
    chosen = digest_frame(spark).filter("false").withColumn("place", F.lit(1))
    stats = run.withColumns({"total_collected": F.lit(4), "total_new": F.lit(0)})
    assert digest.render_digest(run, chosen, none, stats, "2026-08-22", rules.Settings(filters=helpers.FILTERS, profile=helpers.PROFILE)).count() == 0
    row = digest.render_digest(run, chosen, none, stats, "2026-08-22", rules.Settings(send_empty_digest=True)).first()
    assert row.subject == "[Listings] No strong new matches - Aug 22" and row.body_text.count("(none)") == 3
    assert "Listings of the day - Saturday, August 22" in row.body_text


def test_stale_streak_breaks_on_a_missing_row(spark):
    runs = spark.createDataFrame([(f"r{i}", "failed" if i == 2 else "completed", f"2026-08-0{i}") for i in range(1, 7)], "run_id string, status string, s string")
    runs = runs.withColumn("started_at", F.col("s").cast("timestamp"))
    rows = [(f"r{i}", "gone", "healthy", 0) for i in (1, 3, 5, 6)] + [(f"r{i}", "still", "healthy", 0) for i in (1, 2, 3, 4, 5)]
    rows += [("r6", "still", "failed", None)]
    found = spark.createDataFrame(rows, "run_id string, source_name string, status string, total_available bigint")
    assert sorted(map(tuple, health.stale_history(found, runs).collect())) == [("r4", "still"), ("r5", "still")]
    now = found.filter("run_id = 'r5'")
    stale = health.stale_now(now, found, runs.filter("run_id < 'r5'"))
    assert [r.source_name for r in stale.collect()] == ["still"]
    assert health.stale_now(now, found, runs.filter("run_id = 'r1'")).count() == 0


def test_run_coverage_knows_daylight_saving(spark):
    runs = spark.createDataFrame(
        [("a", "completed", "2026-03-07 12:00:00"), ("b", "completed", "2026-03-10 03:30:00"), ("c", "failed", "2026-03-10 12:00:00")],
        "run_id string, status string, s string",
    ).withColumn("started_at", F.col("s").cast("timestamp"))
    dates = sorted(str(r.local_date) for r in health.covered_dates(runs, "America/New_York").collect())
    assert dates == ["2026-03-07", "2026-03-09"]
    assert sorted(str(r.local_date) for r in health.uncovered_dates(runs, "America/New_York").collect()) == ["2026-03-08", "2026-03-10"]
    assert health.should_run(runs, "America/New_York", "2026-03-10 13:00:00").first().run_due is True
    assert health.should_run(runs, "America/New_York", "2026-03-10 02:00:00").first().run_due is False


def test_batch_key_depends_on_the_set_of_keys_alone(spark):
    rows = spark.createDataFrame([("b", "k2"), ("b", "k1"), ("b", "k2"), ("c", "x"), ("d", "k1")], "batch string, key string")
    keys = {r.batch: r.batch_key for r in watch.batch_keys(rows, "batch").collect()}
    again = {r.batch: r.batch_key for r in watch.batch_keys(rows.orderBy("key").repartition(5).distinct(), "batch").collect()}
    digests = [hashlib.sha256(k).hexdigest() for k in (b"k1", b"k2")]
    sums = [str(sum(int(d[at : at + 15], 16) for d in digests)) for at in (0, 15, 30)]
    assert keys["b"] == hashlib.sha256("|".join(["2", *sums]).encode()).hexdigest()[:32]
    assert keys == again and len(set(keys.values())) == 3


POSTING = {"id": "1", "title": "Software Engineer - New Grad 2027", "location": "U.S. Remote", "descriptionHtml": "<p>Build backend services.</p>",
           "applyUrl": "https://jobs.ashbyhq.com/d/1/application", "isListed": True, "employmentType": "FullTime"}


def postings(spark, *changes):
    rows = [{**POSTING, **change} for change in changes]
    names = [f.split()[0] for f in watch.POSTING_DDL.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], watch.POSTING_DDL)


def test_posting_labels(spark):
    dropped = [
        {"title": "Senior Software Engineer"}, {"title": "Software Engineer II"}, {"title": "Advanced Support Engineer I"},
        {"title": "Software Engineering Intern"}, {"title": "Software Engineer Co-op"}, {"location": "Remote - Mexico"}, {"location": "Remote - Canada"},
        {"descriptionHtml": "<p>Requires 5+ years of experience.</p>"}, {"descriptionHtml": "<p>For graduates in the class of 2026.</p>"},
        {"isListed": False}, {"employmentType": "Intern"},
    ]
    kept = ["Junior Software Engineer", "Associate Software Engineer", "Software Engineer I", "Software Engineer", "Backend Engineer"]
    found = watch.classify_postings(postings(spark, *dropped, *[{"title": t} for t in kept], {}), helpers.FILTERS).collect()
    assert [r.label is None for r in found] == [True] * 11 + [False] * 6
    assert found[-1].label == watch.EARLY_MATCH and found[-3].label == watch.UNCLEAR
    odd = watch.classify_postings(postings(spark, {"id": None}, {"id": "", "applyUrl": "https://evil.example/1"}), helpers.FILTERS)
    assert [r.key for r in odd.collect()] == ["https://jobs.ashbyhq.com/d/1", "https://evil.example/1"]
    assert [r.url for r in watch.invalid_matches(odd).collect()] == ["https://evil.example/1"]


def test_guard_refuses_foreign_state(spark):
    seen = spark.createDataFrame([("a", "k", None)], "scope string, key string, first_seen_at timestamp").withColumn("first_seen_at", F.lit("2026-01-01").cast("timestamp"))
    assert store.guard_scope(seen, "a").count() == 1
    for bad in (
        lambda: store.guard_scope(seen, "b"),
        lambda: store.guard_scope(seen, "a", stored_version=2),
        lambda: store.guard_scope(seen.withColumn("key", F.lit(None).cast("string")), "a"),
        lambda: store.guard_scope(seen.withColumn("first_seen_at", F.lit("x")), "a"),
    ):
        with pytest.raises(store.StateRefused):
            bad()


def test_retention(spark):
    seen = spark.range(100).select(
        F.lit("s").alias("scope"), F.col("id").cast("string").alias("key"), F.timestamp_seconds(F.col("id") % 10).alias("first_seen_at")
    )
    kept = store.retain_latest(seen, 15).collect()
    assert len(kept) == 15 and min(r.first_seen_at for r in kept).second == 8


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = runtime.checkpoint_folder(spark)
    assert folder and (named is None or folder == named)
