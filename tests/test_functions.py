"""Literal expectations for the column functions."""

import hashlib
from urllib.parse import parse_qsl, urlencode, urljoin

import pytest
from pyspark.sql import functions as F

import helpers
from feedloom import rules
from feedloom.functions import details, relevance, text, times, urls
from feedloom.sources import pages
from helpers import lit, one

FILTERS = helpers.FILTERS


@pytest.mark.parametrize(
    "place, allowed",
    [
        ("Toronto, ON, Canada", False),
        ("Remote - Canada", False),
        ("Seattle, WA", True),
        ("SF", True),
        ("LA", True),
        ("Remote, United States", True),
        ("US", True),
        (None, True),
        ("", True),
        ("Berlin", False),
        ("Milwaukee, WI", True),
        ("Milwaukee", False),
        ("Indianapolis, Indiana", True),
        ("Remote", True),
        ("Washington", True),
    ],
)
def test_location_rule(spark, place, allowed):
    assert one(spark, relevance.location_allowed(lit(place), FILTERS)) is allowed


@pytest.mark.parametrize(
    "title, description, context, relevant",
    [
        ("Software Engineering Intern", "Summer internship role", "", False),
        ("Embedded Software Engineer", "Firmware and hardware focus", "", False),
        ("Senior Software Engineer", "Backend platform role", "", False),
        ("Software Engineer II", "Backend platform role", "", False),
        ("Software Engineer, Mid", "Backend platform role", "new_grad_jobs_repo", False),
        ("Experienced Software Engineer", "Backend platform role", "new_grad_jobs_repo", False),
        ("Software Engineer", "General SWE role for 4+ years of experience", "", False),
        ("Software Engineer", "General SWE role for 4+ years of experience", "new grad", False),
        ("Software Engineer", "Entry-level role for 2027 graduates in the United States", "", True),
        ("Software Engineer - New College Grad 2026", "", "", False),
        ("Software Engineer - New College Grad 2027", "", "", True),
        ("Software Engineer", "", "", False),
        ("Software Engineer", "", "curated-new_grad https://example.com/listings.json", True),
        ("Advanced Support Engineer I", "Entry-level role", "", False),
        ("Technical Support Engineer", "New graduate role", "", False),
        ("Software Engineer I", "Build tools for technical support teams", "", True),
        ("Software Engineer", "For people with 0-2 years in the field", "", True),
        ("Nurse", "Entry level role", "", False),
    ],
)
def test_role_rule(spark, title, description, context, relevant):
    column = relevance.is_relevant_role(lit(title), lit(description), FILTERS, lit(context))
    assert one(spark, column) is relevant


def test_role_rejection_names_the_rule(spark):
    assert one(spark, relevance.role_rejection(lit("Staff Software Engineer"), lit(""), FILTERS)) == "senior_title"
    assert one(spark, relevance.role_rejection(lit("Software Engineer"), lit("QA 3 years"), FILTERS)) == "excluded_word"


def test_cohort(spark):
    bad = "Software Engineer New Grad https://example.com/new-college-grad-2026/job"
    assert one(spark, relevance.cohort_allowed(lit(bad), FILTERS)) is False
    assert one(spark, relevance.cohort_allowed(lit("Grad 2026 or 2027"), FILTERS)) is True
    assert one(spark, relevance.cohort_allowed(lit("Grad 20277"), FILTERS)) is True


UUID = "622e1f1e-4a39-4e7c-8526-1189ca588066"


@pytest.mark.parametrize(
    "url, normal, ats",
    [
        (
            f"https://jobs.ashbyhq.com/Faros-AI/{UUID}/application?embed=true",
            f"https://jobs.ashbyhq.com/Faros-AI/{UUID}",
            f"ashby::faros-ai::{UUID}",
        ),
        ("http://www.Example.com/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2", None),
        ("https://boards.greenhouse.io/figma/jobs/12345", "https://boards.greenhouse.io/figma/jobs/12345", "greenhouse::12345"),
        ("https://www.ixl.com/company/jobs?gh_jid=8615710002", "https://ixl.com/company/jobs?gh_jid=8615710002", "greenhouse::8615710002"),
        (f"https://jobs.lever.co/Plaid/{UUID.upper()}/apply", f"https://jobs.lever.co/Plaid/{UUID.upper()}", f"lever::plaid::{UUID}"),
        (
            "https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/Remote/Engineer_JR-1002",
            "https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/Remote/Engineer_JR-1002",
            "workday::acme.wd5.myworkdayjobs.com::jr-1002",
        ),
        ("https://careers.icims.com/jobs/77/engineer/job", "https://careers.icims.com/jobs/77/engineer/job", "icims::careers.icims.com::77"),
        ("https://x.org/p?q=a%20b*c~d&blank=&bad=%zz", "https://x.org/p?bad=%25zz&blank=&q=a+b%2Ac~d", None),
        ("https://x.org/apply", "https://x.org", None),
        ("not a url", "not a url", None),
        ("  https://x.org/a  ", "https://x.org/a", None),
        ("https://x.org/?token=abc&gh_jid=", "https://x.org?gh_jid=&token=abc", None),
    ],
)
def test_url_identity(spark, url, normal, ats):
    assert one(spark, urls.normalize_url(lit(url))) == normal
    assert one(spark, urls.ats_identity(lit(url))) == ats
    primary = f"ats::{ats}" if ats else f"url::{normal}"
    assert one(spark, urls.canonical_key(lit(url))) == hashlib.sha256(primary.encode()).hexdigest()


def test_query_encoding_matches_the_standard_library(spark):
    query = "z=%C3%A9&a=1+2&m=%2F%3F&a=0&s=a,b;c&t=~*'()!"
    wanted = urlencode(sorted(parse_qsl(query, keep_blank_values=True)))
    assert one(spark, urls.normalize_url(lit("https://x.org/p?" + query))) == "https://x.org/p?" + wanted


@pytest.mark.parametrize(
    "link", ["/jobs/1", "jobs/1", "//cdn.x.org/a", "https://y.org/b", "?page=2", "../up/x", "./here", "a/../../b?c=d", "#top", ""]
)
def test_resolve_link(spark, link):
    base = "https://x.org/careers/list?q=1"
    assert one(spark, urls.resolve_link(lit(base), lit(link))) == urljoin(base, link)


def test_hosts(spark):
    def on(url, domains):
        return one(spark, urls.on_domain(lit(url), domains))

    assert on("https://www.linkedin.com/jobs/1", rules.FEED_AGGREGATORS)
    assert on("https://de.indeed.com/x", rules.FEED_AGGREGATORS)
    assert not on("https://notindeed.com/x", rules.FEED_AGGREGATORS)
    assert on("https://wellfound.com/x", rules.SEARCH_AGGREGATORS)
    assert one(spark, urls.careers_url(lit(None), lit("https://x.org"))) == "https://x.org/careers"


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://jobs.ashbyhq.com/open-ai/1", "Open Ai"),
        ("https://jobs.lever.co/o'neil-2go/1", "O'Neil 2Go"),
        ("https://boards.greenhouse.io/figma/jobs/1", "Figma"),
        ("https://x.greenhouse.io/v1/boards/data-dog/jobs", "Data Dog"),
        ("https://jobs.smartrecruiters.com/Acme/1", "Acme"),
        ("https://example.com/jobs", None),
        ("https://jobs.lever.co/", None),
    ],
)
def test_company_from_url(spark, url, name):
    assert one(spark, urls.company_from_url(lit(url))) == name


def test_job_details(spark):
    found = one(
        spark,
        details.job_details(
            lit("Software Engineer, New Grad 2027"),
            lit(
                "Hybrid role. Salary is $120,000 - $145,000 per year. We cannot provide visa sponsorship. "
                "Applicants must be a U.S. citizen and eligible for a security clearance. "
                "Apply by August 15, 2026. Candidates should graduate in 2027."
            ),
            lit("New York, NY"),
            F.lit(False),
        ),
    )
    assert found.asDict() == {
        "salary": "$120,000 - $145,000 per year",
        "work_mode": "Hybrid",
        "sponsorship": "Not offered",
        "citizenship": "U.S. citizenship required",
        "clearance": "Must be eligible for clearance",
        "graduation_years": ["2027"],
        "application_deadline": "August 15, 2026",
    }


def test_detail_items(spark):
    found = details.job_details(lit("x"), lit("graduating 2028, graduation: 2027. $20/hr"), lit(None), F.lit(True))
    assert one(spark, details.detail_items(found)) == ["Work mode: Remote", "Salary: $20/hr", "Graduation: 2027, 2028"]


@pytest.mark.parametrize(
    "value, moment",
    [
        ("2026-08-20T12:00:00Z", "2026-08-20 12:00:00"),
        ("2026-08-20", "2026-08-20 00:00:00"),
        ("2026-08-20T12:00:00+02:00", "2026-08-20 10:00:00"),
        ("1724155200", "2024-08-20 12:00:00"),
        ("1724155200000", "2024-08-20 12:00:00"),
        ("Aug 20, 2026", "2026-08-20 00:00:00"),
        ("August 5, 2026", "2026-08-05 00:00:00"),
        ("20 Aug 2026", "2026-08-20 00:00:00"),
        ("8/20/2026", "2026-08-20 00:00:00"),
        ("Thu, 20 Aug 2026 12:00:00 +0000", "2026-08-20 12:00:00"),
        ("Posted 3 Days Ago", None),
        ("2026-13-40", None),
        ("", None),
        (None, None),
        ("99999999999999999999", None),
    ],
)
def test_parse_posted(spark, value, moment):
    assert one(spark, times.parse_posted(lit(value)).cast("string")) == moment


def test_freshness_is_inclusive(spark):
    posted = times.as_timestamp("2026-08-01 00:00:00")
    assert one(spark, times.within_days(posted, "2026-08-08 00:00:00", 7)) is True
    assert one(spark, times.within_days(posted, "2026-08-08 00:00:01", 7)) is False
    assert one(spark, times.within_days(posted, "2026-08-21 00:00:00", 30)) is True
    assert one(spark, times.within_days(F.lit(None).cast("timestamp"), "2026-08-08", 7)) is True


def test_text_helpers(spark):
    assert one(spark, text.title_slug(lit("  Full-Stack  Engineer (C++), 2027! "))) == "full stack engineer c 2027"
    assert one(spark, text.fold_hint(lit(" New-Grad_Jobs "))) == "new grad jobs"
    assert one(spark, text.normalized_location(lit(" New  York,\tNY "))) == "New York, NY"
    assert one(spark, text.is_remote(lit("Hybrid - NYC"))) is True
    assert one(spark, text.is_remote(lit(None))) is False


def test_summaries(spark):
    def summary(value, label):
        return one(spark, text.readable_summary(lit(value), label))

    raw = "Fit 75/100 \x021strong Python overlap; product work aligns."
    assert summary(raw, "Fit") == "Strong Python overlap. Product work aligns."
    assert summary("Difficulty 45/100 \x021high applicant volume.", "Difficulty") == "High applicant volume."
    assert summary("", "Fit") == "No additional detail was available."
    assert summary("Fit 81/100 — one; two; three.", "Fit") == "One. Two."
    assert one(spark, text.plain_summary(lit("a–b \x07 ‘c’"))) == "a-b 'c'"


def test_links_and_headline(spark):
    found = one(spark, text.links_in_text(lit("Apply now at careers.example.com/jobs/123, or www.x.org! see careers.example.com/jobs/123")))
    assert found == ["https://careers.example.com/jobs/123", "https://www.x.org"]
    story = "Hi\nDinner was great tonight\n  - Software roles are open |"
    assert one(spark, text.headline(lit(story))) == "Software roles are open"
    assert one(spark, text.headline(lit("12345678 90"))) == "New Story"
    assert one(spark, text.headline(lit("Dinner was great\r\nok"))) == "Dinner was great"
    for words in ("Software Engineer Intern applications are open", "New grad SWE role", "Apply at the company careers site"):
        assert one(spark, text.mentions_job(lit(words), text.links_in_text(lit(words)))) is True
    assert one(spark, text.mentions_job(lit("Dinner was great"), text.links_in_text(lit("Dinner was great")))) is False


@pytest.mark.parametrize(
    "title, head, place",
    [
        (
            "Software Engineer, Fullstack, Early Career San Francisco, California; New York, New York",
            "Software Engineer, Fullstack, Early Career",
            "San Francisco, California; New York, New York",
        ),
        ("Software Engineer (Remote, US)", "Software Engineer", "Remote, US"),
        ("Software Engineer - New Grad - Seattle", "Software Engineer - New Grad", "Seattle"),
        ("Software Engineer | Austin | Team", "Software Engineer", "Austin | Team"),
        ("Engineer - Austin, TX - Boston", "Engineer - Austin, TX", "Boston"),
        ("Software Engineer (Payments)", "Software Engineer (Payments)", None),
        ("Software   Engineer", "Software Engineer", None),
        ("", "", None),
    ],
)
def test_split_title(spark, title, head, place):
    found = one(spark, pages.split_title(lit(title)))
    assert (found["title"], found["location"]) == (head, place)
