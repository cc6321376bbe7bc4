"""The two polls: postings of one board, and items of story pages. Both deliver a key once.

A poll validates everything before it writes anything: the payload, the seen-set's scope, and every
matching posting. Deliveries are written under the poll number before the keys are remembered, so a
repeated poll delivers the same rows and nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.text import headline, links_in_text, materialize, mentions_job
from feedloom.functions.times import as_timestamp
from feedloom.operators import store, watch
from feedloom.sources import boards, stories
from feedloom.streaming import first_seen


class PollFailed(RuntimeError):
    """The polled source is unreadable, is another one, or exposes too little."""


def _guarded(spark: SparkSession, folder: str, scope: str) -> bool:
    """Refuse a folder that belongs to another scope; tell whether a poll ran before."""
    pointer = store.read_pointer(spark, folder)
    if pointer is None:
        return False
    if pointer.get("version") != 1:
        raise store.StateRefused("seen-set has an unsupported format")
    if pointer.get("scope") != scope:
        raise store.StateRefused("seen-set belongs to another scope")
    store.guard_scope(first_seen.read_seen(spark, folder), scope)
    return True


def _remember_scope(spark: SparkSession, folder: str, scope: str) -> None:
    store.write_pointer(spark, folder, {"version": 1, "scope": scope})


def poll_board(
    spark: SparkSession, payload: DataFrame, folder: str, poll: int, as_of: str, filters: rules.Filters
) -> DataFrame:
    """Poll one board; returns total, matching and notified postings.

    ``payload`` is one landed payload row of a supported platform that carries posting fields.
    """
    found = boards.board_items(payload)
    failure = found.select("failure").first()
    if failure is None or failure[0] is not None:
        raise PollFailed("no payload was landed" if failure is None else failure[0])
    scope = payload.select("api_url").first()[0]
    _guarded(spark, folder, scope)
    postings = found.select(F.posexplode("items").alias("position", "raw")).select(
        "position", F.from_json("raw", watch.POSTING_DDL).alias("p")
    ).select("position", "p.*")
    classified = watch.classify_postings(postings, filters).withColumn("scope", F.lit(scope))
    # Everything is read from one written copy of the classification.
    path = f"{folder}/classified/poll={poll}"
    classified.write.mode("overwrite").parquet(path)
    classified = spark.read.schema(classified.schema).parquet(path)
    matches = classified.filter(F.col("label").isNotNull()).withColumns(
        {"seen_at": as_timestamp(as_of), "message": board_message()}
    )
    _remember_scope(spark, folder, scope)
    first_seen.process_batch(
        matches, poll, folder, ["position"], valid=F.col("url").startswith(watch.BOARD_PREFIX)
    )
    delivered = spark.read.parquet(f"{folder}/delivered/batch={poll}")
    return watch.watch_counts(classified, delivered)


def board_message():
    """Text of one posting alert."""
    place = F.coalesce(F.nullif("locationName", F.lit("")), F.nullif("location", F.lit("")), F.lit("Not specified"))
    return F.concat_ws(
        "\n",
        "label",
        F.lit(""),
        "title",
        F.concat(F.lit("Location: "), place),
        F.concat(F.lit("Apply: "), F.col("url")),
        F.lit(""),
        F.lit("Check the requirements before you apply."),
        F.lit(""),
        "description",
    )


def poll_stories(
    spark: SparkSession,
    pages: DataFrame,
    texts: DataFrame,
    folder: str,
    poll: int,
    as_of: str,
    username: str,
    notify_first: bool = False,
) -> DataFrame:
    """Poll story pages of one profile; returns total, new and notified items.

    ``texts`` holds the landed text per item key; items without a text count as relevant, as no one
    has read them yet. The first poll of a profile only sets the baseline unless asked otherwise.
    """
    items = stories.story_items(pages, username)
    path = f"{folder}/items/poll={poll}"
    items.write.mode("overwrite").parquet(path)
    items = spark.read.schema(items.schema).parquet(path)
    broken = stories.failed_pages(items).first()
    if broken is not None:
        raise PollFailed(broken.failure)
    known_before = _guarded(spark, folder, username)
    listed = items.filter(F.col("key").isNotNull()).withColumns(
        {"scope": F.lit(username), "seen_at": as_timestamp(as_of)}
    )
    read = materialize(listed.join(texts.select("key", "text"), "key", "left"), links=links_in_text(F.col("text")))
    judged = materialize(
        read,
        relevant=F.coalesce(mentions_job(F.col("text"), F.col("links")), F.lit(True)),
        headline=F.when(
            F.col("text").isNull(), F.concat(F.lit("New "), "media_type", F.lit(" Story"))
        ).otherwise(headline(F.col("text"))),
    )
    before = first_seen.read_seen(spark, folder).filter(F.col("batch") != poll).select("scope", "key")
    _remember_scope(spark, folder, username)
    first_seen.process_batch(
        judged, poll, folder, ["page_id", "position"], relevant=F.col("relevant"), baseline=not notify_first and not known_before
    )
    totals = listed.groupBy("scope", "key").agg(F.min("position").alias("position"))
    fresh = watch.unseen(totals, before)
    sent = spark.read.parquet(f"{folder}/delivered/batch={poll}").select("scope", "key", F.lit(True).alias("sent"))
    return watch.story_counts(totals, fresh.join(sent, ["scope", "key"], "left"), F.coalesce(F.col("sent"), F.lit(False)))
