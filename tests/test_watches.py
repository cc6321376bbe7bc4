"""Both polls on literal payloads."""

import json

import pytest
from pyspark.sql import functions as F

import helpers
from feedloom import rules
from feedloom.operators import store
from feedloom.operators.watch import InvalidMatch
from feedloom.plans import watches
from feedloom.sources.stories import item_key
from feedloom.streaming import first_seen

AS_OF = "2026-08-22 08:00:00"


def payload(spark, postings, api="https://api.ashbyhq.com/d"):
    body = postings if isinstance(postings, str) else json.dumps({"jobs": postings})
    return spark.createDataFrame(
        [(0, "ashby", "D", "d", api, "", body)],
        "source_ordinal int, platform string, company_name string, identifier string, api_url string, careers_url string, body string",
    )


def posting(key, title="Software Engineer - New Grad 2027", **more):
    return {"id": key, "title": title, "location": "U.S. Remote", "descriptionHtml": "<p>Build backend services.</p>",
            "applyUrl": f"https://jobs.ashbyhq.com/d/{key}/application", **more}


def poll(spark, folder, number, rows, **more):
    return watches.poll_board(spark, payload(spark, rows, **more), folder, number, AS_OF, helpers.FILTERS).first()


def test_board_poll(spark, folder):
    rows = [posting(str(i)) for i in range(3)] + [posting("generic", "Software Engineer"), posting("x", "Senior Software Engineer")]
    first = poll(spark, folder, 0, rows)
    assert (first.total_jobs, first.matching_jobs, first.notified_jobs) == (5, 4, 4)
    assert poll(spark, folder, 1, rows).notified_jobs == 0
    assert poll(spark, folder, 2, [*rows, posting("new")]).notified_jobs == 1
    messages = [r.message for r in first_seen.read_delivered(spark, folder).collect()]
    assert len(messages) == 5 and any(m.startswith("Eligibility unclear") for m in messages)
    assert all("Build backend services." in m and "Location: U.S. Remote" in m for m in messages)


def test_board_poll_fails_closed(spark, folder):
    for bad in ('{"errors": [{"message": "down"}]}', "{broken", '{"other": 1}'):
        with pytest.raises(watches.PollFailed):
            poll(spark, folder, 0, bad)
    assert store.read_pointer(spark, folder) is None
    with pytest.raises(InvalidMatch):
        poll(spark, folder, 0, [posting("1"), posting("2", applyUrl="https://evil.example/2")])
    assert first_seen.read_seen(spark, folder).count() == 0
    assert poll(spark, folder, 0, [posting("1")]).notified_jobs == 1
    with pytest.raises(store.StateRefused):
        poll(spark, folder, 1, [posting("1")], api="https://api.ashbyhq.com/other")


def story_page(*items):
    spans = "".join(
        f'<span data-type="stories" data-id="{i}" data-media-type="video" data-content="https://c/{i}" data-filename="{f}"></span>' for i, f in items
    )
    return f"<html><title>zero Stories</title>{spans}</html>"


def test_story_poll(spark, folder):
    def run(number, items, texts=(), **more):
        pages = spark.createDataFrame([(1, story_page(*items))], "page_id bigint, html string")
        landed = spark.createDataFrame(list(texts), "key string, text string")
        row = watches.poll_stories(spark, pages, landed, folder, number, AS_OF, "zero", **more).first()
        return (row.total_items, row.new_items, row.notified_items, row.notification_sent)

    one, two, three = ("v1", "s1.mp4"), ("v2", "s2.mp4"), ("v3", "s3.mp4")
    assert run(0, [one]) == (1, 1, 0, False)
    assert run(1, [one]) == (1, 0, 0, False)
    assert run(2, [one, two]) == (2, 1, 1, True)
    third = spark.range(1).select(item_key(F.lit("s3.mp4"), F.lit("v3"), F.lit("u"))).first()[0]
    assert run(3, [one, two, three], [(third, "Dinner was great")]) == (3, 1, 0, False)
    assert run(4, [three]) == (1, 0, 0, False)
    assert first_seen.read_seen(spark, folder).count() == 3
    assert [r.headline for r in first_seen.read_delivered(spark, folder).collect()] == ["New video Story"]
    short = spark.createDataFrame([(1, "<html><title>other</title></html>")], "page_id bigint, html string")
    with pytest.raises(watches.PollFailed):
        watches.poll_stories(spark, short, spark.createDataFrame([], "key string, text string"), folder, 5, AS_OF, "zero")
