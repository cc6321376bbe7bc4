"""First-seen streams: replay, suppression, baseline, refusal, batch equivalence."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators.watch import InvalidMatch
from feedloom.streaming import first_seen, seen

ORDER = ["seen_at", "n"]


def batch(spark, *rows):
    frame = spark.createDataFrame([(s, k, n, r) for s, k, n, r in rows], "scope string, key string, n int, relevant boolean")
    return frame.withColumn("seen_at", F.timestamp_seconds(F.col("n")))


def delivered(spark, folder):
    return sorted((r.scope, r.key, r.n) for r in first_seen.read_delivered(spark, folder).collect())


def known(spark, folder):
    return sorted((r.scope, r.key) for r in first_seen.read_seen(spark, folder).collect())


def test_each_key_once_and_replay(spark, folder):
    one = batch(spark, ("a", "x", 2, True), ("a", "x", 1, True), ("b", "x", 3, True))
    two = batch(spark, ("a", "x", 4, True), ("a", "y", 5, True))
    first_seen.process_batch(one, 0, folder, ORDER)
    first_seen.process_batch(two, 1, folder, ORDER)
    expected = [("a", "x", 1), ("a", "y", 5), ("b", "x", 3)]
    assert delivered(spark, folder) == expected
    # A replay of the last batch finds its own keys, and still delivers the same rows.
    first_seen.process_batch(two, 1, folder, ORDER)
    assert delivered(spark, folder) == expected and known(spark, folder) == [("a", "x"), ("a", "y"), ("b", "x")]
    keys = {r.key: r.delivery_key for r in first_seen.read_delivered(spark, folder).collect()}
    assert len(set(keys.values())) == 2


def test_replay_after_a_crash_before_remembering(spark, folder, monkeypatch):
    rows = batch(spark, ("a", "x", 1, True))
    original = first_seen.item_key

    def crash(*_):
        raise RuntimeError("delivery failed")

    monkeypatch.setattr(first_seen, "item_key", crash)
    with pytest.raises(RuntimeError):
        first_seen.process_batch(rows, 0, folder, ORDER)
    assert known(spark, folder) == []
    monkeypatch.setattr(first_seen, "item_key", original)
    first_seen.process_batch(rows, 0, folder, ORDER)
    assert delivered(spark, folder) == [("a", "x", 1)]


def test_suppressed_items_are_remembered(spark, folder):
    first_seen.process_batch(batch(spark, ("a", "x", 1, False), ("a", "y", 2, True)), 0, folder, ORDER, relevant=F.col("relevant"))
    assert delivered(spark, folder) == [("a", "y", 2)] and known(spark, folder) == [("a", "x"), ("a", "y")]
    first_seen.process_batch(batch(spark, ("a", "x", 3, True)), 1, folder, ORDER, relevant=F.col("relevant"))
    assert delivered(spark, folder) == [("a", "y", 2)]


def test_baseline(spark, folder):
    first_seen.process_batch(batch(spark, ("a", "x", 1, True)), 0, folder, ORDER, baseline=True)
    assert delivered(spark, folder) == [] and known(spark, folder) == [("a", "x")]
    first_seen.process_batch(batch(spark, ("a", "x", 2, True), ("a", "y", 2, True), ("b", "z", 2, True)), 1, folder, ORDER, baseline=True)
    assert delivered(spark, folder) == [("a", "y", 2)] and ("b", "z") in known(spark, folder)


def test_one_invalid_item_stops_the_batch(spark, folder):
    with pytest.raises(InvalidMatch):
        first_seen.process_batch(batch(spark, ("a", "x", 1, True), ("a", "y", 2, False)), 0, folder, ORDER, valid=F.col("relevant"))
    assert known(spark, folder) == []


def test_stream_in_many_batches_equals_one(spark, folder):
    data = spark.range(200).select(
        F.lit("s").alias("scope"), (F.col("id") % 17).cast("string").alias("key"), F.col("id").cast("int").alias("n"),
        F.lit(True).alias("relevant"), F.timestamp_seconds("id").alias("seen_at"),
    )
    for start in range(0, 200, 50):
        data.filter((F.col("n") >= start) & (F.col("n") < start + 50)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    answers = []
    for name, files in (("many", 1), ("one", 100)):
        stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        first_seen.watch_stream(stream, f"{folder}/{name}", f"{folder}/{name}/checkpoint", ORDER).awaitTermination()
        answers.append(delivered(spark, f"{folder}/{name}"))
    assert answers[0] == answers[1] == sorted(("s", str(i), i) for i in range(17))


def test_folded_keys_stay_known(spark, folder):
    """Batches stay bounded above the base, and the answer is that of a watch that never folds."""
    for number in range(7):
        rows = [("a", str(k), 100 * number + k, k % 2 == 0) for k in range(number, number + 4)] + [("s%d" % number, "x", 1, True)]
        for name, after in (("folded", 2), ("plain", 100)):
            first_seen.process_batch(
                batch(spark, *rows), number, f"{folder}/{name}", ORDER, relevant=F.col("relevant"), baseline=True, compact_after=after, buckets=4
            )
        assert len(seen.open_batches(spark, f"{folder}/folded")) <= 2
    assert delivered(spark, f"{folder}/folded") == delivered(spark, f"{folder}/plain") != []
    assert known(spark, f"{folder}/folded") == known(spark, f"{folder}/plain")
    # A replay of the last batch delivers the same rows; one of a folded batch is refused.
    before = delivered(spark, f"{folder}/folded")
    first_seen.process_batch(
        batch(spark, *rows), 6, f"{folder}/folded", ORDER, relevant=F.col("relevant"), baseline=True, compact_after=2, buckets=4
    )
    assert delivered(spark, f"{folder}/folded") == before
    with pytest.raises(seen.ReplayRefused):
        first_seen.process_batch(batch(spark, *rows), 0, f"{folder}/folded", ORDER)


def test_fold_that_dies_changes_nothing(spark, folder, monkeypatch):
    first_seen.process_batch(batch(spark, ("a", "x", 1, True)), 0, folder, ORDER)

    def crash(*_):
        raise RuntimeError("no pointer")

    with monkeypatch.context() as patched:
        patched.setattr(seen.store, "write_pointer", crash)
        with pytest.raises(RuntimeError):
            seen.fold(spark, folder, [0], 4)
    assert known(spark, folder) == [("a", "x")] and seen.open_batches(spark, folder) == [0]
    seen.fold(spark, folder, [0], 4)
    assert known(spark, folder) == [("a", "x")] and seen.open_batches(spark, folder) == []


def test_base_is_not_shuffled(spark, folder):
    first_seen.process_batch(batch(spark, *[("a", str(k), k, True) for k in range(50)]), 0, folder, ORDER)
    seen.fold(spark, folder, [0], 4)
    items = batch(spark, ("a", "x", 1, True), ("a", "7", 1, True))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rest = seen.unseen(items, folder, 1)
        assert [r.key for r in rest.collect()] == ["x"]
        plan = rest._jdf.queryExecution().sparkPlan().toString()
        executed = rest._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in executed or "bucketed" in plan.lower()
    # The items are dealt to the buckets; the base is read in them.
    assert executed.count("hashpartitioning(_item") in (1, 2) and "hashpartitioning(item" not in executed
