"""State of base, deltas and aliases: whole rows, plans and bytes."""

import os

import pytest
from pyspark.sql import functions as F

import helpers
from feedloom import rules
from feedloom.functions.urls import canonical_key
from feedloom.operators import lifecycle, state, store
from feedloom.plans import daily_run
from feedloom.schemas import STATE_DDL, select_collected

SMALL = rules.Settings(filters=helpers.FILTERS, profile=helpers.PROFILE, state_buckets=4, compact_after=3)


def stored(spark, rows):
    """Rows (key, address, title, first seen) as ``merge_state`` returns them."""
    given = spark.createDataFrame(rows, "canonical_key string, apply_url string, title string, first_seen string")
    own = {"job_id": F.concat(F.lit("j-"), "canonical_key"), "first_seen_at": F.col("first_seen").cast("timestamp"), "today_key": canonical_key(F.col("apply_url"))}
    rows = given.withColumns(own)
    for field in state.T.StructType.fromDDL(state.DELTA_DDL).fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rows


def key_of(spark, url):
    return helpers.one(spark, canonical_key(F.lit(url)))


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def titles(frame):
    return {r.canonical_key: r.title for r in frame.collect()}


def test_rows_aliases_and_compaction(spark, folder):
    a, b, c = (f"https://x.example/jobs/{n}" for n in "abc")
    assert state.rows(spark, folder).collect() == [] and state.alias_index(spark, folder).collect() == []
    first = [("old-a", a, "1", "2026-01-02"), ("older-a", a, "1", "2026-01-01"), ("old-b", b, "1", "2026-01-01"), (key_of(spark, c), c, "1", "2026-01-01")]
    state.stage(stored(spark, first), folder, 0)
    assert state.rows(spark, folder).count() == 0
    state.publish(spark, folder, 0)
    index = {r.canonical_key: r.alias_key for r in state.alias_index(spark, folder).collect()}
    assert index == {key_of(spark, a): "older-a", key_of(spark, b): "old-b"}
    whole = lifecycle.alias_index(state.rows(spark, folder))
    assert index == {r.canonical_key: r.alias_key for r in whole.collect()}

    # b is stored under its own key as well, which beats the alias; older-a moves to c, whose key is stored.
    state.stage(stored(spark, [(key_of(spark, b), b, "2", "2026-01-03"), ("older-a", c, "2", "2026-01-01")]), folder, 1)
    state.publish(spark, folder, 1)
    want = {"old-a": "1", "older-a": "2", "old-b": "1", key_of(spark, b): "2", key_of(spark, c): "1"}
    assert titles(state.rows(spark, folder)) == want
    for _ in range(2):
        assert {r.canonical_key: r.alias_key for r in state.alias_index(spark, folder).collect()} == {key_of(spark, a): "old-a"}
        keys = spark.createDataFrame([("older-a",), ("none",), ("old-b",)], "canonical_key string")
        assert titles(state.rows_of(spark, folder, keys)) == {"older-a": "2", "old-b": "1"}
        version = state.compact(spark, folder, 4)
        assert titles(state.rows(spark, folder)) == want
    # A row whose key has become today's loses its alias.
    state.stage(stored(spark, [("old-a", a, "3", "2026-01-02")]).withColumn("today_key", F.lit("old-a")), folder, version + 1)
    state.publish(spark, folder, version + 1)
    assert state.alias_index(spark, folder).collect() == []
    with pytest.raises(store.StateRefused):
        state.publish(spark, folder, version)


def test_plan_reads_keys_only_and_does_not_move_the_base(spark, folder, monkeypatch):
    rows = [(f"k{i}", f"https://x.example/jobs/{i}", "t", "2026-01-01") for i in range(200)]
    state.stage(stored(spark, rows), folder, 0)
    state.publish(spark, folder, 0)
    state.compact(spark, folder, 4)
    plan = state.alias_index(spark, folder)._jdf.queryExecution().executedPlan().toString()
    read = [part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:]]
    assert any(columns.startswith("struct<canonical_key:string>") for columns in read) and not any("apply_url" in columns for columns in read)
    # Beyond the size for a broadcast, the keys go to the buckets and the base stays.
    monkeypatch.setattr(state, "fits_broadcast", lambda _: False)
    keys = spark.range(50).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("canonical_key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = state.rows_of(spark, folder, keys)
        assert found.count() == 50
        plan = found._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        # The base, the left side of the first join, is read in its buckets: no exchange above its scan.
        base = join[: join.index("FileScan")]
        assert "Bucketed: true" in join and "LeftSemi" in base and "Exchange" not in base
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def listings(spark, numbers):
    rows = [(0, i, f"https://x.example/jobs/{i}", "Acme", "Software Engineer, New Grad", f"text {i} " + "x" * 300) for i in numbers]
    given = spark.createDataFrame(rows, "source_ordinal int, position bigint, apply_url string, company_name string, title string, description_text string")
    return select_collected(given, source_name=F.lit("s"), source_type=F.lit("t"), location_text=F.lit("Remote, US"))


def test_bytes_of_a_run_follow_its_batch(spark, folder):
    days = ("2026-08-01", "2026-08-02", "2026-08-03", "2026-08-04", "2026-08-05")
    batches = (range(400), [1], [2, 900], [3], [900])
    sizes, before = [], 0
    for number, (day, numbers) in enumerate(zip(days, batches)):
        daily_run.run(spark, daily_run.Inputs(collected=[listings(spark, numbers)]), folder, f"r{number}", f"{day} 08:00:00", SMALL)
        sizes.append(written(f"{folder}/state/deltas") - before)
        before += sizes[-1]
    pointer = store.read_pointer(spark, f"{folder}/state")
    assert max(sizes[1:]) < sizes[0] / 5
    # The first load became the base; the last run met three deltas and compacted them first.
    assert pointer["base"] == 5 and pointer["deltas"] == [6]
    found = {r.apply_url: (str(r.last_seen_at)[:10], r.current_status) for r in daily_run.read_state(spark, folder).collect()}
    assert len(found) == 401 and found["https://x.example/jobs/900"] == ("2026-08-05", "seen")
    assert found["https://x.example/jobs/1"] == ("2026-08-02", "seen") and found["https://x.example/jobs/7"] == ("2026-08-01", "new")
    assert daily_run.read_state(spark, folder).columns == state.names(STATE_DDL)
