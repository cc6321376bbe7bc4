"""Listing state that follows the batch: a bucketed base, a delta per run, an alias index, compaction.

Layout below a state folder; a pointer file names what is in force and is replaced in one step:

* ``base/v=<n>``: all rows as of the last compaction, bucketed and sorted by key
* ``deltas/v=<n>``: the rows that one run changed, whole rows, each with the key that its address gives today
* ``aliases/v=<n>``: for the same rows, today's key of those that are stored under another one

A run writes one delta and one part of the alias index, both as large as its batch. It reads the base by key and
without a shuffle of it, for the keys of its batch only; no identity is computed over stored rows. ``compact`` folds the deltas
into a new base and rebuilds the aliases, as a batch job of its own; the deltas before it are then no longer read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from feedloom import rules
from feedloom.functions.urls import canonical_key
from feedloom.operators import store
from feedloom.runtime import fits_broadcast
from feedloom.schemas import STATE_DDL

KEY = "canonical_key"
DELTA_DDL = STATE_DDL + ", today_key string, lifecycle_state string, source_ordinal int, position bigint"
ALIAS_DDL = "alias_key string, canonical_key string, age struct<first_seen_at:timestamp,job_id:string>"


def names(ddl: str) -> list[str]:
    """Column names of a layout; needs a session."""
    return T.StructType.fromDDL(ddl).fieldNames()


def _parts(spark: SparkSession, root: str, name: str, versions: list[int], ddl: str) -> DataFrame:
    """Written parts with their version ``v``."""
    if not versions:
        return spark.createDataFrame([], f"{ddl}, v int")
    paths = [f"{root}/{name}/v={v}" for v in versions]
    return spark.read.schema(f"{ddl}, v int").option("basePath", f"{root}/{name}").parquet(*paths)


def _pointer(spark: SparkSession, root: str) -> dict:
    return store.read_pointer(spark, root) or {"version": -1, "base": None, "deltas": [], "buckets": 0}


def _base(spark: SparkSession, root: str, pointer: dict) -> DataFrame:
    if pointer["base"] is None:
        return spark.createDataFrame([], STATE_DDL)
    return store.read_version(spark, f"{root}/base", pointer["base"], STATE_DDL, KEY, pointer["buckets"])


def _latest(rows: DataFrame) -> DataFrame:
    """The row of the highest version per key; each task drops the others before the shuffle."""
    order = Window.partitionBy(KEY).orderBy(F.col("v").desc())
    return rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place", "v")


def rows(spark: SparkSession, root: str) -> DataFrame:
    """The whole state in force."""
    pointer = _pointer(spark, root)
    if not pointer["deltas"]:
        return _base(spark, root, pointer)
    changed = _latest(_parts(spark, root, "deltas", pointer["deltas"], DELTA_DDL).select(*names(STATE_DDL), "v"))
    rest = _base(spark, root, pointer).join(changed.select(KEY), KEY, "left_anti")
    return rest.select(*names(STATE_DDL)).unionByName(changed)


def rows_of(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """The stored rows of some keys; ``keys`` has one column, canonical_key, without repeats."""
    pointer = _pointer(spark, root)
    side = F.broadcast(keys) if fits_broadcast(keys) else keys
    found = _base(spark, root, pointer).join(side, KEY, "left_semi")
    if not pointer["deltas"]:
        return found
    base = found.withColumn("v", F.lit(-1))
    deltas = _parts(spark, root, "deltas", pointer["deltas"], DELTA_DDL).select(*names(STATE_DDL), "v")
    return _latest(base.select(*names(STATE_DDL), "v").unionByName(deltas.join(side, KEY, "left_semi")))


def _aliases(spark: SparkSession, root: str, pointer: dict) -> DataFrame:
    """(alias_key, canonical_key, age) of the rows in force that are stored under another key than today's."""
    versions = ([] if pointer["base"] is None else [pointer["base"]]) + pointer["deltas"]
    parts = _parts(spark, root, "aliases", versions, ALIAS_DDL)
    held = parts.groupBy("alias_key").agg(F.max_by(F.struct("canonical_key", "age"), "v").alias("a"))
    return held.select("alias_key", "a.*").filter(F.col("canonical_key").isNotNull())


def alias_index(spark: SparkSession, root: str) -> DataFrame:
    """Like ``lifecycle.alias_index``, from the maintained table: the oldest row of a key, unless the key itself is stored."""
    pointer = _pointer(spark, root)
    oldest = _aliases(spark, root, pointer).groupBy("canonical_key").agg(F.min_by("alias_key", "age").alias("alias_key"))
    deltas = _parts(spark, root, "deltas", pointer["deltas"], DELTA_DDL).select(KEY)
    return oldest.join(_base(spark, root, pointer).select(KEY), KEY, "left_anti").join(deltas, KEY, "left_anti")


def next_version(spark: SparkSession, root: str) -> int:
    return _pointer(spark, root)["version"] + 1


def stage(changed: DataFrame, root: str, version: int) -> DataFrame:
    """Write the rows that a run changed, and their aliases, without publishing them; returns the rows as read back.

    ``changed`` is the result of ``merge_state`` over the rows of the batch's keys. A row that the batch did not touch, but a
    decision did, has no ``today_key``: its alias stays.
    """
    spark = changed.sparkSession
    changed.select(*names(DELTA_DDL)).write.mode("overwrite").parquet(f"{root}/deltas/v={version}")
    staged = _parts(spark, root, "deltas", [version], DELTA_DDL).drop("v")
    touched = staged.filter(F.col("today_key").isNotNull()).select(
        F.col(KEY).alias("alias_key"), F.when(F.col("today_key") != F.col(KEY), F.col("today_key")).alias("canonical_key"),
        F.struct("first_seen_at", "job_id").alias("age"),
    )
    # A row that is stored under today's key needs an entry only if it had another one.
    had = _aliases(spark, root, _pointer(spark, root)).select("alias_key")
    moved = touched.filter(F.col("canonical_key").isNull()).join(had, "alias_key", "left_semi")
    entries = touched.filter(F.col("canonical_key").isNotNull()).unionByName(moved)
    entries.write.mode("overwrite").parquet(f"{root}/aliases/v={version}")
    return staged


def publish(spark: SparkSession, root: str, version: int, **extra) -> None:
    """Put a staged delta in force."""
    pointer = _pointer(spark, root)
    if version <= pointer["version"]:
        raise store.StateRefused(f"version {version} is not after {pointer['version']}")
    store.write_pointer(spark, root, {**pointer, **extra, "version": version, "deltas": [*pointer["deltas"], version]})


def compact(spark: SparkSession, root: str, buckets: int = rules.Settings.state_buckets) -> int:
    """Write the state in force as a new base; returns its version. A compaction that dies changes nothing."""
    version = next_version(spark, root)
    base = store.stage_snapshot(rows(spark, root), f"{root}/base", version, KEY, buckets)
    today = canonical_key(F.col("apply_url"))
    aliases = base.select(F.col(KEY).alias("alias_key"), today.alias("canonical_key"), F.struct("first_seen_at", "job_id").alias("age"))
    aliases.filter("alias_key <> canonical_key").write.mode("overwrite").parquet(f"{root}/aliases/v={version}")
    store.write_pointer(spark, root, {"version": version, "base": version, "deltas": [], "buckets": buckets})
    return version


def compact_when_due(spark: SparkSession, root: str, buckets: int, after: int) -> bool:
    """Compact if that many deltas lie above the base, or the first load lies there without one."""
    pointer = _pointer(spark, root)
    due = len(pointer["deltas"]) >= after or (pointer["base"] is None and bool(pointer["deltas"]))
    if due:
        compact(spark, root, buckets)
    return due


def union_keys(*frames: DataFrame) -> DataFrame:
    """Distinct keys of some tables, as ``rows_of`` takes them."""
    return reduce(DataFrame.unionByName, [f.select(KEY) for f in frames]).filter(F.col(KEY).isNotNull()).distinct()
