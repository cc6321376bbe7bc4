"""Payload shapes, page parsing and source rules on literal rows."""

import json

from pyspark.sql import functions as F

import helpers
from feedloom import rules
from feedloom.functions import relevance
from feedloom.operators import enrichment
from feedloom.sources import boards, html, markdown, outcomes, pages, search, stories, structured

FILTERS = helpers.FILTERS
AS_OF = "2026-08-22 00:00:00"
UUID = "622e1f1e-4a39-4e7c-8526-1189ca588066"
BOARD_DDL = (
    "source_ordinal int, platform string, company_name string, identifier string, api_url string, careers_url string, body string"
)


def board(spark, *rows):
    frame = spark.createDataFrame(
        [(i, p, c, c.lower(), api, "", b if b is None or isinstance(b, str) else json.dumps(b)) for i, (p, c, api, b) in enumerate(rows)],
        BOARD_DDL,
    )
    return frame.withColumn("fetched_at", F.lit(AS_OF).cast("timestamp"))


def test_board_shapes(spark):
    grad = "Software Engineer, New Grad"
    judged = boards.judged_postings(
        board(
            spark,
            ("greenhouse", "A", "u", {"jobs": [{"id": 1, "title": grad, "absolute_url": "https://x/1", "location": "not a struct", "content": "c"}]}),
            ("lever", "B", "u", [{"id": "l1", "text": grad, "hostedUrl": "https://x/2", "createdAt": 1724155200000, "descriptionPlain": "", "description": "long", "categories": {"location": "San Francisco, CA"}},
                                 {"id": "l2", "text": "Quantitative Analyst, Early Career", "categories": {"location": "New York, NY"}}]),
            ("ashby", "C", "u", {"data": {"jobsBoard": {"jobs": [{"id": "a1", "title": grad, "locationName": "Seattle, WA", "publishedDate": "2026-08-21T13:00:00Z", "applyUrl": "https://x/3", "descriptionHtml": "<p>x</p>", "employmentType": "Full-time"}]}}}),
            ("Ashby", "D", "u", {"jobs": [{"id": "a2", "title": grad, "location": "Remote", "jobUrl": "https://x/4"}], "errors": []}),
            ("ashby", "E", "u", {"jobs": [], "errors": [{"message": "down"}]}),
            ("ashby", "F", "u", {"other": 1}),
            ("ashby", "G", "u", {"jobs": ["text"]}),
            ("smartrecruiters", "H", "u", {"content": [{"id": "s1", "name": grad, "ref": "https://x/5", "location": {"city": "Austin", "region": "TX"}, "jobAd": {"sections": {"jobDescription": {"text": "t"}}}}]}),
            ("workday", "I", "u", {"jobPostings": [{"bulletFields": [grad], "locationsText": "Boston, MA", "postedOn": "Posted 3 Days Ago", "externalPath": "/job/1"}]}),
            ("workday", "J", "", {"jobPostings": [{"title": grad}]}),
            ("workday", "K", "u", {"data": []}),
            ("lever", "L", "u", {"ok": False}),
            ("greenhouse", "M", "u", "{broken"),
            ("taleo", "N", "u", {}),
            ("gem", "O", "u", {"data": {"oatsExternalJobPostings": {"jobPostings": [
                {"id": "e", "extId": "p1", "title": grad, "locations": [{"name": "United States", "city": ""}], "job": {"locationType": "REMOTE", "employmentType": "FULL_TIME"}},
                {"id": "p2", "title": grad, "locations": [{"name": "Remote - US"}, {"city": "Austin"}, {"name": "Remote - US"}], "job": {"locationType": "remote"}},
                {"id": "p3", "title": grad, "locations": []}]}}}),
            ("greenhouse", "P", "u", {"meta": 1}),
        ),
        FILTERS,
    ).cache()
    rows = {r.external_job_id: r for r in boards.collect_boards(judged).collect()}
    assert set(rows) == {"1", "l1", "a1", "a2", "s1", None, "p1", "p2", "p3"}
    assert rows["1"].location_text is None and rows["1"].source_name == "greenhouse:A"
    assert str(rows["l1"].posted_at) == "2024-08-20 12:00:00" and rows["l1"].description_text == "long"
    assert rows["a1"].employment_type == "Full-time" and rows["a2"].apply_url == "https://x/4"
    assert rows["s1"].location_text == "Austin, TX"
    assert rows[None].title == grad and rows[None].apply_url == "/job/1" and rows[None].posted_at is None
    assert rows["p1"].location_text == "Remote, United States" and rows["p1"].apply_url == "https://jobs.gem.com/o/p1"
    assert rows["p2"].location_text == "Remote - US, Austin" and rows["p3"].location_text is None

    listed = judged.select("source_name", "supported").distinct()
    health = {r.source_name.split(":")[1]: r for r in outcomes.board_outcomes(listed, judged).collect()}
    failed = {n for n, r in health.items() if r.status == "failed"}
    assert failed == {"E", "F", "G", "L", "M"}
    assert "down" in health["E"].error and health["N"].status == "unsupported"
    assert (health["B"].total_available, health["B"].relevant_jobs) == (2, 1)
    assert [(health[n].status, health[n].total_available) for n in "JKP"] == [("healthy", 0)] * 3
    assert {r.source_name for r in outcomes.source_errors(outcomes.board_outcomes(listed, judged)).collect()} == {
        "ashby:E", "ashby:F", "ashby:G", "lever:L", "greenhouse:M"
    }


def test_feed_paths(spark):
    body = json.dumps({"data": [{"jobs": [{"a": 1}, {"a": 2}]}], "text": "x", "empty": []})
    frame = spark.createDataFrame([(body,), ("{broken",), ('[{"a": 3}]',)], "body string")

    def sizes(path):
        return [r[0] for r in frame.select(F.size(structured.extract_rows(F.col("body"), path))).collect()]

    assert sizes("data.0.jobs") == [2, -1, -1] or sizes("data.0.jobs") == [2, None, None]
    assert sizes("")[2] == 1
    assert sizes("empty")[0] == 0
    has = [r[0] for r in frame.select(structured.has_path(F.col("body"), "text")).collect()]
    assert has == [True, False, False]


def test_markdown_table(spark):
    body = """
| Company | Position | Location | Posting | Age |
|---|---|---|---|---|
| <a href="https://example.com"><strong>Example</strong></a> | Full-Stack Software Engineer - New Grad 2027 | Remote - USA | <a href="https://example.com/jobs/1">Apply</a> | 2d |
| <a href="https://example.com"><strong>Old</strong></a> | Software Engineer - New Grad | Seattle, WA | <a href="https://example.com/jobs/2">Apply</a> | 90d |
| ↳ | Software Engineer - New Grad | Seattle, WA | <a href="https://example.com/jobs/3">Apply</a> | 1d |
| Short | row |
| NoLink | Software Engineer - New Grad | Seattle, WA | closed | 1d |
| No age | Software Engineer - New Grad | | <a href='https://example.com/jobs/4?a=1&amp;b=2'>Apply</a> | new |
"""
    frame = spark.createDataFrame([(0, "new_grad_2027", "https://md", body)], "source_ordinal int, source_name string, source_url string, body string")
    frame = frame.withColumn("fetched_at", F.lit(AS_OF).cast("timestamp"))
    rows = markdown.collect_markdown(frame, rules.Settings(filters=helpers.FILTERS, profile=helpers.PROFILE), AS_OF).orderBy("position").collect()
    assert [r.company_name for r in rows] == ["Example", "No age"]
    assert rows[0].apply_url == "https://example.com/jobs/1" and rows[0].location_text == "Remote - USA"
    assert str(rows[0].posted_at) == "2026-08-20 00:00:00" and rows[0].confidence == 0.8
    assert rows[1].apply_url == "https://example.com/jobs/4?a=1&b=2" and rows[1].location_text is None
    assert markdown.table_rows(markdown.table_lines(frame)).count() == 5


def test_markdown_header_in_force(spark):
    body = "| stray | row |\n| Company | Role |\n| a | b |\ntext\n| c | d |\n| Company | Position | Location |\r\n| Company | Role |\n|--|--|\n| e | f |"
    rows = [(1, body), (2, None), (3, ""), (4, "| a | b |"), (5, "| Company | Role |")]
    lines = markdown.table_lines(spark.createDataFrame(rows, "id int, body string")).orderBy("id", "position").collect()
    found = [(r.id, r.position, r.cells, r.names) for r in lines]
    role = ["company", "role"]
    assert found == [(1, 2, ["a", "b"], role), (1, 4, ["c", "d"], role), (1, 8, ["e", "f"], role)]


def test_markdown_many_headers(spark):
    import time

    body = "\n".join(("| Company | Role |\n" + "| a | b |\n" * 99) for _ in range(1000))
    frame = spark.createDataFrame([(1, body)], "id int, body string")
    start = time.time()
    assert markdown.table_lines(frame).count() == 99_000
    # By header and line this would be 1e8 steps; the bound is wide for a slow machine.
    assert time.time() - start < 60


POSTING = {
    "@type": "JobPosting",
    "title": "Software Engineer, New Grad",
    "description": "<p>Build &amp; ship</p><p>APIs</p>",
    "hiringOrganization": {"name": "Canva"},
    "jobLocation": [{"address": {"addressLocality": "Austin", "addressRegion": "TX", "addressCountry": "US"}}],
    "identifier": {"value": 7},
    "datePosted": "2026-08-20",
    "url": "/jobs/7",
}


def page_frame(spark, *rows):
    frame = spark.createDataFrame([(i, u, h, c) for i, (u, h, c) in enumerate(rows)], "page_id bigint, url string, html string, company_name string")
    return frame.withColumns({"source_name": F.lit("company:x"), "source_type": F.lit("company_page"), "source_ordinal": F.lit(0), "priority_tier": F.lit(1)})


def ld(value):
    return f'<html><script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script></html>'


def test_page_postings(spark):
    nested = {"a": [{"@graph": [{"x": POSTING}, {"@type": "Thing"}], "ignored": POSTING}]}
    remote = {"@type": "JobPosting", "title": "Software Engineer I", "applicantLocationRequirements": {"name": "USA"}}
    facts = html.page_facts(
        page_frame(
            spark,
            ("https://canva.com/careers", ld(nested), None),
            ("https://x.org/a", ld("{broken") + ld([remote]), "Known"),
            ("https://x.org/b", ld(remote), None),
        )
    )
    rows = {r.page_id: r for r in pages.posting_listings(facts, FILTERS).collect()}
    assert set(rows) == {0, 1}
    assert rows[0].company_name == "Canva" and rows[0].location_text == "Austin, TX, US"
    assert rows[0].apply_url == "https://canva.com/jobs/7" and rows[0].description_text == "Build & ship APIs"
    assert rows[0].external_job_id == "7" and str(rows[0].posted_at) == "2026-08-20 00:00:00"
    assert rows[1].company_name == "Known" and rows[1].location_text == "USA" and rows[1].apply_url == "https://x.org/a"


def test_anchor_fallback(spark):
    link = '<html><head><title>Acme Jobs</title></head><body><a href="{}">{}</a></body></html>'
    notion = "Software Engineer, Fullstack, Early Career San Francisco, California; New York, New York"
    facts = html.page_facts(
        page_frame(
            spark,
            ("https://example.com/jobs", link.format("/jobs/123", "Software Engineer, New Grad 2027"), "Example"),
            ("https://www.notion.so/careers", link.format("https://jobs.ashbyhq.com/notion/123", notion), None),
            ("https://x.org", link.format("/about", "Software Engineer, New Grad 2027"), None),
            ("https://x.org", link.format("/jobs/1", "Software Engineer I"), None),
            ("https://y.org/p", ld(POSTING) + link.format("/jobs/123", "Software Engineer, New Grad 2027"), None),
        )
    )
    rows = {r.apply_url: r for r in pages.page_listings(facts, FILTERS, F.lit(True)).collect()}
    assert set(rows) == {"https://example.com/jobs/123", "https://jobs.ashbyhq.com/notion/123", "https://y.org/jobs/7"}
    notion_row = rows["https://jobs.ashbyhq.com/notion/123"]
    assert notion_row.title == "Software Engineer, Fullstack, Early Career" and notion_row.company_name == "Acme Jobs"
    assert notion_row.location_text == "San Francisco, California; New York, New York" and notion_row.confidence == 0.6
    assert pages.page_listings(facts, FILTERS, F.lit(False)).count() == 1


def test_discovered_boards(spark):
    body = '<a href="https://jobs.ashbyhq.com/Notion">Jobs</a> https://jobs.ashbyhq.com/notion/1 https://boards.greenhouse.io/a_b'
    found = pages.discovered_boards(spark.createDataFrame([(1, body)], "page_id bigint, html string")).collect()
    assert {(r.platform, r.identifier) for r in found} == {("ashby", "Notion"), ("greenhouse", "a_b")}


def test_scan_list(spark):
    frame = spark.createDataFrame(
        [("g", "Gamma", 3, True), ("a", "Alpha", 1, True), ("b", "Beta", 3, True), ("d", "Disabled", 1, False)],
        "slug string, name string, priority_tier int, enabled boolean",
    )
    assert [r.name for r in pages.scan_list(frame, ("Beta",), 2).collect()] == ["Beta", "Alpha"]


def test_descriptions(spark):
    meta = '<html><head><meta property="og:description" content="Build scalable &lt;b&gt;APIs&lt;/b&gt; with Python."></head><body><main>Nav</main></body></html>'
    box = '<div class="x job-description">Short <p>text<p>more<ul><li>a<li>b</ul></div><div id="content">A much longer description of the job</div>'
    inner = ld({"@type": "JobPosting", "description": "outer", "part": {"@type": "JobPosting", "description": "the nested posting is longer"}})
    facts = html.page_facts(page_frame(spark, ("u1", meta, None), ("u2", box, None), ("u3", "<p>none</p>", None), ("u4", inner, None)))
    found = {r.url: r.description for r in pages.best_description(facts).collect()}
    assert found == {
        "u1": "Build scalable APIs with Python.",
        "u2": "A much longer description of the job",
        "u3": "",
        "u4": "the nested posting is longer",
    }


def test_html_text():
    assert html.plain_text("<p>Build &amp;amp; run</p><script>var x='<p>'</script><!-- c --> a  b<br>c") == "Build & run a  b c"
    assert html.plain_text(None) == "" and html.plain_text("&lt;b&gt;x&lt;/b&gt;") == "x"


def test_story_page(spark):
    good = """<html><head><title>zero Stories</title></head><body>
      <span data-type="stories" data-id="a" data-slide="0" data-media-type="image" data-content="https://c/a" data-filename="f.heic"></span>
      <span data-type="stories" data-id="b" data-slide="x" data-media-type="gif" data-content="https://c/b" data-filename="d/f.heic"></span>
      <span data-type="stories" data-id="c" data-media-type="VIDEO" data-content="https://c/c"></span>
      <span data-type="other" data-id="d" data-content="https://c/d"></span></body></html>"""
    empty = "<html><head><title>zero - profile</title></head></html>"
    short = '<html><title>zero</title><div class="profile__stories-counter"> 47 </div></html>'
    challenge = "<html><title>Just a moment</title><div>captcha</div></html>"
    profile = '<html><title>x</title><h1>ZERO</h1></html>'
    frame = spark.createDataFrame(list(enumerate([good, empty, short, challenge, "<p>hi</p>", profile])), "page_id bigint, html string")
    rows = stories.story_items(frame, "zero").collect()
    items = sorted([r for r in rows if r.key], key=lambda r: r.position)
    assert [(r.viewer_id, r.media_type, r.slide, r.filename) for r in items] == [("a", "image", 0, "f.heic"), ("c", "video", None, "")]
    assert all(len(r.key) == 32 for r in items)
    assert {r.page_id: r.failure for r in stories.failed_pages(stories.story_items(frame, "zero")).collect()} == {
        2: "advertised 47 items but exposed only 0",
        3: "challenge page",
        4: "unexpected profile",
    }


def test_search(spark):
    body = json.dumps({"queries": {"q1": [{"title": "Figma Software Engineer, New Grad", "url": "https://jobs.lever.co/figma/1", "snippet": " s ", "source_name": "e"},
                                          {"title": "Jobs", "url": "https://wellfound.com/x", "source_name": "e"},
                                          {"title": "Jobs", "url": "https://acme.org/jobs", "source_name": "e"}],
                                   "q2": [{"title": "Jobs", "url": "https://acme.org/jobs", "source_name": "e"}]}})
    results = search.results_from_payloads(spark.createDataFrame([(0, body)], "source_ordinal int, body string"))
    link = '<html><title>Acme</title><a href="/jobs/1">Software Engineer, New Grad</a></html>'
    landed = spark.createDataFrame([(1, "https://acme.org/jobs", link), (2, "https://wellfound.com/x", link)], "page_id bigint, url string, html string")
    rows = search.search_listings(results, html.page_facts(landed), FILTERS, 10).collect()
    assert sorted((r.search_query, r.company_name, r.apply_url, r.confidence) for r in rows) == [
        ("q1", "Acme", "https://acme.org/jobs/1", 0.6),
        ("q1", "Figma", "https://jobs.lever.co/figma/1", 0.55),
        ("q2", "Acme", "https://acme.org/jobs/1", 0.6),
    ]
    assert search.top_results(results, 1).count() == 2


def test_guards_cover_their_patterns():
    for word in (*rules.NO_SPONSOR_WORDS, *rules.SPONSOR_WORDS):
        assert any(m in word for m in rules.MENTIONS_SPONSOR_WORDS)
    for word in (*rules.ACTIVE_CLEARANCE_WORDS, *rules.ELIGIBLE_CLEARANCE_WORDS):
        assert any(m in word for m in rules.MENTIONS_CLEARANCE_WORDS)
    for word in ("entry level", "entry-level", "recent graduate", "new grad", "university graduate"):
        assert word in rules.EARLY_CAREER_WORDS and word in rules.ENTRY_TEXT_PATTERN


def test_enrichment_order(spark):
    rows = spark.createDataFrame(
        [("k1", "Engineer", "2026-08-20", 0, 0), ("k2", "Engineer 2027", None, 0, 1), ("k3", "Engineer, New Grad", "2026-08-01", 0, 2),
         ("k4", "Engineer, New Grad", "2026-08-01", 0, 3), ("k5", "Engineer", None, 0, 4)],
        "canonical_key string, title string, posted string, source_ordinal int, position int",
    ).withColumns({"posted_at": F.col("posted").cast("timestamp"), "description_text": F.lit("short")})
    picked = enrichment.pick_sparse(rows, rules.Limits(max_enrichments=4)).collect()
    assert [r.canonical_key for r in picked] == ["k3", "k4", "k2", "k1"]


def test_non_us_signal(spark):
    assert spark.range(1).select(relevance.non_us_signal(F.lit("Paris, France"))).first()[0]
