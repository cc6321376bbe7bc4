"""Registered queries: watches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.text import links_in_text, materialize, mentions_job
from feedloom.operators import store, watch
from feedloom.plans.source_queries import story_pages
from feedloom.plans.testbed import FILTERS, LISTINGS_CTE, listings, scratch, sql_any, table, wide
from feedloom.plans.text_queries import cohort_sql, location_sql, relevant_sql
from feedloom.sources import stories
from feedloom.streaming import first_seen, lifecycle_stream

QUERIES = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = (query, sql)
        return query

    return keep


# --- posting watch ---------------------------------------------------------------------------

_KINDS = ("FullTime", "Intern", "Contract")


def _postings(spark, sf_dir):
    """Board postings derived from listings; descriptions carry markup."""
    number = F.col("doc_id")
    return listings(spark, sf_dir).select(
        F.when(number % 8 != 3, number.cast("string")).alias("id"),
        F.when(number % 16 == 9, "Software Engineering Intern").otherwise(F.col("title")).alias("title"),
        F.col("location_text").alias("location"),
        F.lit(None).cast("string").alias("locationName"),
        F.concat(F.lit("<p>"), "description_text", F.lit("</p><p>Done</p>")).alias("descriptionHtml"),
        F.lit(None).cast("string").alias("descriptionPlain"),
        F.concat(F.lit("https://jobs.ashbyhq.com/acme/"), number.cast("string"), F.lit("/application")).alias("applyUrl"),
        F.lit(None).cast("string").alias("jobUrl"),
        (number % 10 != 6).alias("isListed"),
        F.lit(False).alias("isRemote"),
        F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (number % 3 + 1).cast("int")).alias("employmentType"),
        F.col("source_name").alias("scope"),
        "doc_id",
    )


_YEARS = "regexp_extract_all(title || ' ' || d || ' ' || coalesce(location_text, ''), '" + rules.GRADUATION_PATTERN + "', 1, 'i')"
_WATCH_CTE = f"""{LISTINGS_CTE}, w0 AS (SELECT * EXCLUDE (title), CASE WHEN doc_id % 16 = 9 THEN 'Software Engineering Intern' ELSE title END AS title,
        trim(description_text, chr(32)||chr(10)||chr(9)||chr(13)) || CASE WHEN trim(description_text, chr(32)||chr(10)||chr(9)||chr(13)) = '' THEN 'Done' ELSE ' Done' END AS d FROM listings),
    w1 AS (SELECT *, lower(title) AS t, lower(title || ' ' || d) AS a FROM w0),
    classified AS (SELECT doc_id, source_name, CASE WHEN doc_id % 10 = 6 OR doc_id % 3 = 1 OR NOT {location_sql("coalesce(location_text, '')")} OR NOT {cohort_sql('title')}
            OR regexp_matches(title, '{rules.INTERN_TITLE_PATTERN}', 'i') OR (len({_YEARS}) > 0 AND NOT list_contains({_YEARS}, '2027')) THEN NULL
        WHEN {relevant_sql()} THEN 'Early-career match' WHEN {relevant_sql('TRUE')} THEN 'Eligibility unclear: review requirements' END AS label,
        CASE WHEN doc_id % 8 <> 3 THEN CAST(doc_id AS VARCHAR) ELSE 'https://jobs.ashbyhq.com/acme/' || doc_id END AS key FROM w1)"""


def _classified(spark, sf_dir):
    return watch.classify_postings(_postings(spark, sf_dir), FILTERS)


@register("classified_postings", f"WITH {_WATCH_CTE} SELECT doc_id, label, key FROM classified")
def classified_postings(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "label", "key")


@register(
    "invalid_matches",
    f"WITH {_WATCH_CTE} SELECT doc_id FROM classified WHERE label IS NOT NULL AND doc_id % 2 = 1",
)
def invalid_matches(spark, sf_dir):
    moved = _classified(spark, sf_dir).withColumn(
        "url", F.when(F.col("doc_id") % 2 == 1, F.replace("url", F.lit("https://jobs."), F.lit("https://careers."))).otherwise(F.col("url"))
    )
    return watch.invalid_matches(moved).select("doc_id")


@register(
    "watch_counts",
    f"WITH {_WATCH_CTE} SELECT source_name AS scope, count(*) AS total_jobs, count(label) AS matching_jobs, "
    "count(label) FILTER (doc_id % 4 <> 0) AS notified_jobs FROM classified GROUP BY 1",
)
def watch_counts(spark, sf_dir):
    found = _classified(spark, sf_dir).select("scope", "key", "label", "doc_id")
    seen = found.filter("doc_id % 4 = 0").select("scope", "key")
    delivered = watch.unseen(found.filter("label is not null"), seen)
    return watch.watch_counts(found, delivered)


# --- keys ------------------------------------------------------------------------------------


def _items(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("scope"),
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        "event_id",
    )


@register(
    "unseen_items",
    "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 50 = 0 AND s.event_type = e.event_type AND s.user_id = e.user_id)",
)
def unseen_items(spark, sf_dir):
    items = _items(spark, sf_dir)
    seen = items.filter("event_id % 50 = 0").select("scope", "key").distinct()
    return watch.unseen(items, seen).select("event_id")


@register("item_keys", "SELECT event_id, sha256(event_type || '|' || user_id) AS delivery_key FROM events")
def item_keys(spark, sf_dir):
    return _items(spark, sf_dir).select("event_id", watch.item_key(F.col("scope"), F.col("key")).alias("delivery_key"))


@register(
    "batch_keys",
    """WITH k AS (SELECT DISTINCT event_type AS scope, CAST(user_id AS VARCHAR) AS key FROM events
        UNION SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders),
    d AS (SELECT *, sha256(key) AS h FROM k),
    g AS (SELECT scope, count(*) AS items,
        sha256(count(*) || '|' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(h, 31, 15) AS BIGINT))) AS merged
        FROM d GROUP BY scope)
    SELECT scope, items, substr(merged, 1, 32) AS batch_key FROM g""",
)
def batch_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.lit("orders").alias("scope"), F.col("o_orderkey").cast("string").alias("key"))
    return watch.batch_keys(_items(spark, sf_dir).select("scope", "key").unionByName(orders), "scope")


@register(
    "guarded_seen_set",
    "SELECT 'events' AS scope, event_type || '-' || user_id AS key, CAST(epoch_us(min(ts)) AS BIGINT) AS first_seen FROM events GROUP BY 1, 2",
)
def guarded_seen_set(spark, sf_dir):
    """The seen-set of a scope that all events belong to; the guard reads all of it before it may be used."""
    items = _items(spark, sf_dir).select(F.lit("events").alias("scope"), F.concat_ws("-", "scope", "key").alias("key"), "seen_at")
    seen = items.groupBy("scope", "key").agg(F.min("seen_at").alias("first_seen_at"))
    return store.guard_scope(seen, "events").select("scope", "key", F.unix_micros("first_seen_at").alias("first_seen"))


@register(
    "story_watch_counts",
    f"""WITH d AS (SELECT source AS scope, doc_id, doc_id % 2 = 1 AS fresh, {sql_any('lower(text)', rules.JOB_TERMS)}
            OR len(regexp_extract_all(text, '(?i)({rules.FREE_TEXT_URL_PATTERN})', 1)) > 0 AS relevant FROM documents)
    SELECT scope, count(*) AS total_items, count(*) FILTER (fresh) AS new_items, count(*) FILTER (fresh AND relevant) AS notified_items,
        count(*) FILTER (fresh AND relevant) > 0 AS notification_sent FROM d GROUP BY scope""",
)
def story_watch_counts(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents", "doc_id").select(F.col("source").alias("scope"), F.col("doc_id").cast("string").alias("key"), "text")
    items = materialize(docs, relevant=mentions_job(F.col("text"), links_in_text(F.col("text")))).drop("text")
    seen = items.filter("cast(key as bigint) % 2 = 0").select("scope", "key")
    return watch.story_counts(items, watch.unseen(items, seen), F.col("relevant"))


# --- streams ---------------------------------------------------------------------------------


def _replay(spark, sf_dir, start, parts: int = 4) -> None:
    """Land the events slice by slice in time order and let the query read each slice before the next.

    A slice is written by as many tasks as read it; ``start`` takes the stream and returns a query that
    ends when all that has landed is read.
    """
    folder = scratch(spark, "events")
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("seen_at"), "user_id", "event_type", "event_id", "props"
    )
    part = F.floor((F.dayofmonth("seen_at") - 1) * parts / 31)
    for number in range(parts):
        events.filter(part == number).write.mode("append").parquet(folder)
        start(spark.readStream.schema(events.schema).parquet(folder)).awaitTermination()


def _append(stream, path: str, checkpoint: str):
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _as_items(batch):
    return batch.select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("key"), "seen_at", "event_id", "props")


def _watched(spark, sf_dir, **options):
    folder = scratch(spark, "watch")
    order = ["seen_at", "event_id"]
    _replay(spark, sf_dir, lambda stream: first_seen.watch_stream(stream, folder, f"{folder}/checkpoint", order, _as_items, **options))
    return folder


_FIRST = "SELECT event_type AS scope, CAST(user_id AS VARCHAR) AS key, min(event_id) AS event_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_seen FROM events GROUP BY 1, 2"


@register("first_seen_stream", _FIRST)
def first_seen_stream(spark, sf_dir):
    """Events replayed as a stream; the result equals the batch answer."""
    folder = _watched(spark, sf_dir)
    return first_seen.read_delivered(spark, folder).select("scope", "key", "event_id", F.unix_micros("seen_at").alias("first_seen"))


@register("compacted_first_seen", _FIRST)
def compacted_first_seen(spark, sf_dir):
    """The same stream with every batch folded into the bucketed base before the next; nothing is delivered twice or lost."""
    folder = _watched(spark, sf_dir, compact_after=1, buckets=8)
    return first_seen.read_delivered(spark, folder).select("scope", "key", "event_id", F.unix_micros("seen_at").alias("first_seen"))


def _slice(spark, sf_dir, number: int, parts: int = 4):
    rows = _as_items(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("seen_at"), "user_id", "event_type", "event_id", "props"))
    return rows.filter(F.floor((F.dayofmonth("seen_at") - 1) * parts / 31) == number)


@register("replayed_batch", _FIRST)
def replayed_batch(spark, sf_dir):
    """The last batch is run a second time, as after a failure; the deliveries are the same."""
    folder = _watched(spark, sf_dir)
    first_seen.process_batch(_slice(spark, sf_dir, 3), 3, folder, ["seen_at", "event_id"])
    return first_seen.read_delivered(spark, folder).select("scope", "key", "event_id", F.unix_micros("seen_at").alias("first_seen"))


@register(
    "refused_batch",
    "SELECT event_type AS scope, CAST(user_id AS VARCHAR) AS key, min(event_id) AS event_id FROM events "
    "WHERE floor((day(ts) - 1) * 4 / 31) <> 1 GROUP BY 1, 2",
)
def refused_batch(spark, sf_dir):
    """One invalid item in the second batch: nothing of that batch is delivered or remembered."""
    folder = scratch(spark, "refused")
    for number in range(4):
        batch = _slice(spark, sf_dir, number)
        valid = F.lit(True) if number != 1 else F.col("event_id") % 5 != 0
        try:
            first_seen.process_batch(batch, number, folder, ["seen_at", "event_id"], valid=valid)
        except watch.InvalidMatch:
            continue
    return first_seen.read_delivered(spark, folder).select("scope", "key", "event_id")


@register(
    "baseline_stream",
    f"""WITH f AS ({_FIRST}), parts AS (SELECT *, floor((day(make_timestamp(first_seen)) - 1) * 4 / 31) AS part FROM f),
    begin AS (SELECT scope, min(part) AS first_part FROM parts GROUP BY scope)
    SELECT scope, count(*) AS known, count(*) FILTER (part > first_part) AS delivered FROM parts JOIN begin USING (scope) GROUP BY scope""",
)
def baseline_stream(spark, sf_dir):
    """What is there in the first batch of a scope is remembered and not delivered."""
    folder = _watched(spark, sf_dir, baseline=True)
    delivered = first_seen.read_delivered(spark, folder).groupBy("scope").agg(F.count(F.lit(1)).alias("delivered"))
    known = first_seen.read_seen(spark, folder).groupBy("scope").agg(F.count(F.lit(1)).alias("known"))
    return known.join(delivered, "scope", "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))


@register(
    "suppressed_stream",
    f"""WITH f AS ({_FIRST}), j AS (SELECT f.*, CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 2 = 0 AS relevant FROM f JOIN events e USING (event_id))
    SELECT scope, count(*) AS known, count(*) FILTER (relevant) AS delivered FROM j GROUP BY scope""",
)
def suppressed_stream(spark, sf_dir):
    """Irrelevant first sightings become known without a delivery."""
    relevant = F.get_json_object("props", "$.k").cast("bigint") % 2 == 0
    folder = _watched(spark, sf_dir, relevant=relevant)
    delivered = first_seen.read_delivered(spark, folder).groupBy("scope").agg(F.count(F.lit(1)).alias("delivered"))
    known = first_seen.read_seen(spark, folder).groupBy("scope").agg(F.count(F.lit(1)).alias("known"))
    return known.join(delivered, "scope", "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))


_STALE = 2


@register(
    "lifecycle_stream",
    f"""WITH s AS (SELECT event_type || '-' || user_id AS k, CAST(ts AS DATE) AS d, max(ts) AS tm, arg_max(props, struct_pack(ts, event_id)) AS h FROM events GROUP BY 1, 2),
    l AS (SELECT *, lag(tm) OVER w AS before, lag(h) OVER w AS old FROM s WINDOW w AS (PARTITION BY k ORDER BY d)),
    r AS (SELECT *, CASE WHEN before IS NULL THEN 'new'
        WHEN epoch_us(tm) - epoch_us(before) >= {_STALE} * 86400000000 AND h IS DISTINCT FROM old THEN 'reopened' ELSE 'seen' END AS state FROM l)
    SELECT k AS canonical_key, CAST(epoch_us(tm) AS BIGINT) AS seen, state AS lifecycle_state,
        CAST(count(*) FILTER (state = 'reopened') OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) AS INTEGER) AS reopened_count FROM r""",
)
def lifecycle_of_stream(spark, sf_dir):
    """Lifecycle per key and day over a replayed stream."""
    folder = scratch(spark, "lifecycle")

    def start(stream):
        sightings = stream.select(
            F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("canonical_key"),
            F.col("props").alias("content_hash"), "seen_at", F.col("event_id").alias("ordinal"),
        )
        return lifecycle_stream.write_daily(sightings, folder, f"{folder}/checkpoint")

    _replay(spark, sf_dir, start)
    rows = lifecycle_stream.lifecycle(lifecycle_stream.read_daily(spark, folder), _STALE)
    return rows.select("canonical_key", F.unix_micros("seen_at").alias("seen"), "lifecycle_state", "reopened_count")


@register(
    "bounded_first_seen",
    "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2",
)
def bounded_first_seen(spark, sf_dir):
    """First sightings with keys that expire after a delay longer than the replayed month."""
    folder = scratch(spark, "bounded")
    order = ["seen_at", "event_id"]
    _replay(
        spark, sf_dir,
        lambda stream: first_seen.watch_stream(stream, folder, f"{folder}/checkpoint", order, _as_items, expire_days=60),
    )
    return first_seen.read_delivered(spark, folder).select(F.col("scope").alias("event_type"), F.col("key").alias("user_id"), "event_id")


_EXPIRED = """WITH e AS (SELECT event_type AS scope, CAST(user_id AS VARCHAR) AS key, ts, event_id, floor((day(ts) - 1) * 4 / 31) AS part FROM events),
    p AS (SELECT scope, key, part, min(ts) AS first_at, max(ts) AS last_at, arg_min(event_id, struct_pack(ts, event_id)) AS event_id FROM e GROUP BY 1, 2, 3),
    w AS (SELECT *, lag(last_at) OVER (PARTITION BY scope, key ORDER BY part) AS before FROM p)
    SELECT scope, key, event_id FROM w WHERE before IS NULL OR epoch_us(first_at) - epoch_us(before) > 5 * 86400000000"""


@register("expired_first_seen", _EXPIRED)
def expired_first_seen(spark, sf_dir):
    """A key that was not seen for five days is delivered again."""
    folder = scratch(spark, "expired")
    order = ["seen_at", "event_id"]
    _replay(
        spark, sf_dir,
        lambda stream: first_seen.watch_stream(stream, folder, f"{folder}/checkpoint", order, _as_items, expire_days=5),
    )
    return first_seen.read_delivered(spark, folder).select("scope", "key", "event_id")


@register(
    "story_first_seen",
    """SELECT page_id, substr(sha256(page_id || '-' || f), 1, 32) AS key FROM pages CROSS JOIN (VALUES ('one.heic'), ('two.mp4')) v(f)
    WHERE page_id % 9 <> 4 AND page_id % 10 <> 3 AND page_id % 11 <> 5 AND page_id % 2 = 1""",
)
def story_first_seen(spark, sf_dir):
    """Items of story pages that no earlier poll saw; even pages were polled before."""
    items = stories.story_items(story_pages(spark, sf_dir), "tester_1").filter("failure is null").withColumn("scope", F.lit("tester_1"))
    seen = items.filter("page_id % 2 = 0").select("scope", "key")
    return watch.unseen(items, seen).select("page_id", "key")


@register("compacted_expired", _EXPIRED)
def compacted_expired(spark, sf_dir):
    """The same with every batch folded before the next: the base keeps the last time of a key."""
    folder = scratch(spark, "expired-folded")
    _replay(
        spark, sf_dir,
        lambda stream: first_seen.watch_stream(
            stream, folder, f"{folder}/checkpoint", ["seen_at", "event_id"], _as_items, expire_days=5, compact_after=1, buckets=8
        ),
    )
    return first_seen.read_delivered(spark, folder).select("scope", "key", "event_id")
