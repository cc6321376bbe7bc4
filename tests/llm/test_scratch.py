import glob
import time

from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm import common, components


def held(spark):
    """Data files of shuffles on this session's disk; earlier ones may be removed meanwhile."""
    folder = spark.conf.get("spark.local.dir", "/tmp")
    return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))


def test_landed_drops_its_shuffles(spark):
    before = held(spark)
    for land in (common.landed, runtime.land):
        rows = land(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "sums")
        assert rows.count() == 100 and rows.agg(F.sum("count")).first()[0] == 10_000
    assert spark.conf.get(runtime.DROP_SHUFFLES, "false") == "false"
    ends = time.time() + 20
    while held(spark) - before and time.time() < ends:
        time.sleep(0.2)
    # Only the sums above, which were not landed, may leave a file for each of their tasks.
    assert len(held(spark) - before) < 8


def test_a_landed_frame_can_be_used_again(spark):
    df = spark.range(1_000).groupBy((F.col("id") % 10).alias("k")).count()
    assert df.count() == 10
    for _ in range(2):
        assert common.landed(df, "sums").count() == df.count() == 10


def test_settled_links_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "landed", lambda df, name: written.append(name) or common.landed(df, name))
    star = spark.createDataFrame([(0, i) for i in range(1, 50)] + [(60, 61), (0, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(star).collect()}
    assert roots == {i: 0 for i in range(50)} | {60: 60, 61: 60}
    assert len(written) == 1


def test_components_by_joins_and_by_broadcast(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i * 7) % 31) for i in range(31)] + [(5, None), (9, 9)]
    links = spark.createDataFrame(chain, "a long, b long")
    found = [set(map(tuple, components.components(links).collect()))]
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 2)
    found.append(set(map(tuple, components.components(links).collect())))
    wanted = {(i, 0) for i in range(41)} | {(100 + i, 101) for i in range(1, 31)}
    assert {x for x in found[0] if x[0] < 100} == {x for x in wanted if x[0] < 100}
    assert found[0] == found[1]
