"""First-seen streams: every key is delivered once per scope, replays included.

Layout of a watch folder:

* ``delivered/batch=<id>``: rows for the reader, replaced as a whole when a batch is replayed
* ``seen/batch=<id>``: keys that the batch made known; ``known/`` holds those of folded batches (``streaming/seen.py``)

A batch first writes its deliveries and then its keys. When a batch is replayed, its own keys are
left out of the anti join; otherwise the second attempt would find everything known and replace
its deliveries with nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.watch import InvalidMatch, item_key
from feedloom.runtime import fits_broadcast
from feedloom.streaming import seen


def read_seen(spark: SparkSession, folder: str) -> DataFrame:
    return seen.read(spark, folder)


def read_delivered(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/delivered").parquet(f"{folder}/delivered")


def first_per_key(items: DataFrame, order: list[str], seen_at: str) -> DataFrame:
    """Earliest row of every (scope, key) in a batch, and ``_until``, its last time; combined before the shuffle."""
    rest = [c for c in items.columns if c not in ("scope", "key")]
    return (
        items.groupBy("scope", "key")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.max(seen_at).alias("_until"))
        .select("scope", "key", "r.*", "_until")
    )


def process_batch(
    batch: DataFrame,
    batch_id: int,
    folder: str,
    order: list[str],
    seen_at: str = "seen_at",
    relevant: Column | None = None,
    baseline: bool = False,
    valid: Column | None = None,
    expire_days: int | None = None,
    compact_after: int = seen.COMPACT_AFTER,
    buckets: int = seen.BUCKETS,
) -> None:
    """Deliver the new items of one batch, then remember their keys.

    ``batch`` has scope, key and the timestamp column ``seen_at``. With ``baseline`` a scope that
    has no keys yet is only remembered. Items that are not ``relevant`` are remembered without
    delivery. If any item is not ``valid``, nothing at all is written.

    With ``expire_days``, a key counts as new again if its first item in the batch comes more than that after
    the last one of earlier batches.

    Once ``compact_after`` earlier batches lie above the base of known keys, they are folded into it first.
    """
    spark = batch.sparkSession
    seen.fold_when_due(spark, folder, batch_id, compact_after, buckets)
    if valid is not None and not batch.filter(~F.coalesce(valid, F.lit(False))).isEmpty():
        raise InvalidMatch("a matching item is invalid; the batch is not delivered")
    # Deliveries and keys must stem from one reading of the batch, so it is written before use.
    staged = f"{folder}/staged/batch={batch_id}"
    first = first_per_key(batch, order, seen_at)
    first.write.mode("overwrite").parquet(staged)
    first = spark.read.schema(first.schema).parquet(staged)
    few = fits_broadcast(first)
    if expire_days is None:
        fresh = seen.unseen(first, folder, batch_id, few)
    else:
        last = seen.last_seen(first, folder, batch_id, few).withColumnRenamed("last", "_last")
        gap = F.unix_micros(seen_at) - F.unix_micros("_last")
        expired = F.col("_last").isNull() | (gap > expire_days * 86_400_000_000)
        fresh = first.join(last, ["scope", "key"], "left").filter(expired).drop("_last")

    wanted = fresh if relevant is None else fresh.filter(F.coalesce(relevant, F.lit(False)))
    if baseline:
        # One row per scope: the scopes that already hold keys.
        wanted = wanted.join(seen.scopes(spark, folder, batch_id), "scope", "left_semi")
    delivery = wanted.drop("_until").withColumn("delivery_key", item_key(F.col("scope"), F.col("key")))
    delivery.write.mode("overwrite").parquet(f"{folder}/delivered/batch={batch_id}")
    # Keys that expire are remembered by their last item, others once.
    kept = first if expire_days is not None else fresh
    kept.select("scope", "key", F.col(seen_at).alias("first_seen_at"), F.col("_until").alias("last_seen_at")).write.mode(
        "overwrite"
    ).parquet(f"{folder}/seen/batch={batch_id}")


def watch_stream(
    stream: DataFrame, folder: str, checkpoint: str, order: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None, **options
) -> StreamingQuery:
    """Run ``process_batch`` over a stream until all available input is read."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        process_batch(prepare(batch) if prepare else batch, batch_id, folder, order, **options)

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
