"""Keys that a watch knows: a delta per batch above a bucketed base.

Layout below a watch folder:

* ``seen/batch=<id>``: keys that one batch made known
* ``known/base/v=<n>``: the keys of all batches up to a folded one, bucketed by a digest of scope and key
* ``known/scopes/v=<n>``: the scopes of the same keys, one row each

A batch reads the base where it lies, without a shuffle of it, and the few deltas above it. When enough deltas lie there they are
folded into a new base, and a pointer that is replaced in one step puts it in force; a fold that dies changes nothing. Keys
that come in several batches, as they do where keys expire, become one with the last time. A folded batch can no longer be replayed and
is refused; a stream replays its last batch only, which is never folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import store
from feedloom.operators.watch import item_key
from feedloom.operators.watch import unseen as unseen_in

SEEN_DDL = "scope string, key string, first_seen_at timestamp, last_seen_at timestamp, batch bigint"
BASE_DDL = SEEN_DDL + ", item string"
COLUMNS = ("scope", "key", "first_seen_at", "last_seen_at", "batch")
COMPACT_AFTER = 32
BUCKETS = 64


class ReplayRefused(RuntimeError):
    """The batch was folded into the base; its own keys cannot be told from earlier ones."""


def _pointer(spark: SparkSession, folder: str) -> dict:
    return store.read_pointer(spark, f"{folder}/known") or {"version": -1, "folded": -1, "buckets": 0}


def open_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches above the base, ascending; from the names of folders alone."""
    folded = _pointer(spark, folder)["folded"]
    names = [name.removeprefix("batch=") for name in store.children(spark, f"{folder}/seen") if name.startswith("batch=")]
    return sorted(int(name) for name in names if int(name) > folded)


def _deltas(spark: SparkSession, folder: str, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], SEEN_DDL)
    paths = [f"{folder}/seen/batch={batch}" for batch in batches]
    return spark.read.schema(SEEN_DDL).option("basePath", f"{folder}/seen").parquet(*paths)


def _base(spark: SparkSession, folder: str) -> DataFrame:
    pointer = _pointer(spark, folder)
    if pointer["version"] < 0:
        return spark.createDataFrame([], BASE_DDL)
    return store.read_version(spark, f"{folder}/known/base", pointer["version"], BASE_DDL, "item", pointer["buckets"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Everything known, a row per key and batch above the base."""
    return _base(spark, folder).select(*COLUMNS).unionByName(_deltas(spark, folder, open_batches(spark, folder)))


def _earlier(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return _deltas(spark, folder, [b for b in open_batches(spark, folder) if b != batch])


def unseen(items: DataFrame, folder: str, batch: int, few_items: bool = False) -> DataFrame:
    """The items (scope, key, ..) that no other batch made known.

    With ``few_items`` (the caller counted them) the base is filtered where it lies by the items; otherwise the items are dealt
    to its buckets.
    """
    spark = items.sparkSession
    marked = items.withColumn("_item", item_key(F.col("scope"), F.col("key")))
    known = _base(spark, folder).select(F.col("item").alias("_item"))
    if few_items:
        known = known.join(F.broadcast(marked.select("_item").distinct()), "_item", "left_semi")
    rest = marked.join(known, "_item", "left_anti").drop("_item")
    return unseen_in(rest, _earlier(spark, folder, batch), few_items)


def last_seen(items: DataFrame, folder: str, batch: int, few_items: bool = False) -> DataFrame:
    """(scope, key, last) of the items that another batch made known: when they were seen last."""
    spark = items.sparkSession
    wanted = items.select("scope", "key", item_key(F.col("scope"), F.col("key")).alias("item")).distinct()
    side = F.broadcast(wanted) if few_items else wanted
    base = _base(spark, folder).join(side.select("item"), "item", "left_semi").select("scope", "key", "last_seen_at")
    deltas = _earlier(spark, folder, batch).join(side.select("scope", "key"), ["scope", "key"], "left_semi")
    found = base.unionByName(deltas.select("scope", "key", "last_seen_at"))
    return found.groupBy("scope", "key").agg(F.max("last_seen_at").alias("last"))


def scopes(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The scopes that other batches hold keys of; the base is not read for it."""
    version, found = _pointer(spark, folder)["version"], _earlier(spark, folder, batch).select("scope")
    if version >= 0:
        found = found.unionByName(spark.read.schema("scope string").parquet(f"{folder}/known/scopes/v={version}"))
    return found.distinct()


def fold(spark: SparkSession, folder: str, batches: list[int], buckets: int = BUCKETS) -> None:
    """Write the base and these batches, all that lie above it up to the last of them, as a new base."""
    pointer = _pointer(spark, folder)
    version = pointer["version"] + 1
    held = _base(spark, folder).select(*COLUMNS).unionByName(_deltas(spark, folder, batches))
    merged = held.groupBy("scope", "key").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("batch").alias("batch")
    )
    merged = merged.withColumn("item", item_key(F.col("scope"), F.col("key")))
    # One file per bucket: the rows are dealt as the buckets are.
    base = store.stage_snapshot(merged.repartition(buckets, "item"), f"{folder}/known/base", version, "item", buckets)
    base.select("scope").distinct().write.mode("overwrite").parquet(f"{folder}/known/scopes/v={version}")
    store.write_pointer(spark, f"{folder}/known", {"version": version, "folded": max(batches), "buckets": buckets})


def fold_when_due(spark: SparkSession, folder: str, batch: int, after: int = COMPACT_AFTER, buckets: int = BUCKETS) -> bool:
    """Fold what lies above the base if that are ``after`` batches or more, without ``batch`` and later ones."""
    if batch <= _pointer(spark, folder)["folded"]:
        raise ReplayRefused(f"batch {batch} is folded")
    before = [b for b in open_batches(spark, folder) if b < batch]
    if len(before) < max(1, after):
        return False
    fold(spark, folder, before, buckets)
    return True
