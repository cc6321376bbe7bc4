"""Rule tables: every word list, host list and threshold the operators take as a parameter.

Operators never hold a list of their own; they read one of the dataclasses below, so the same
code runs on any listing-like table with other rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: role and seniority words -------------------------------------------------

ROLE_WORDS = (
    "software engineer",
    "software developer",
    "full stack",
    "full-stack",
    "frontend",
    "front end",
    "backend",
    "back end",
    "product engineer",
    "engineer i",
    "software engineer i",
    "associate software engineer",
)

EARLY_CAREER_WORDS = (
    "new grad",
    "new graduate",
    "new college grad",
    "recent graduate",
    "university graduate",
    "early career",
    "class of 2027",
    "2027 graduates",
    "graduate program",
    "entry level",
    "entry-level",
)

ENTRY_TITLE_WORDS = (
    "engineer i",
    "software engineer i",
    "associate software engineer",
    "new grad",
    "new graduate",
    "new college grad",
    "recent graduate",
    "university graduate",
    "early career",
    "entry level",
    "entry-level",
)

SUPPORT_TITLE_WORDS = ("support engineer", "technical support")

EXCLUDED_WORDS = (
    "intern ",
    " internship",
    "co-op",
    "co op",
    "firmware",
    "embedded",
    "it support",
    "help desk",
    "qa ",
    "quality assurance",
    "data analyst",
    "business analyst",
    "sales engineer",
    "developer advocate",
    "hardware",
    "site reliability",
    "sre",
    "devops",
    "ml researcher",
    "machine learning research",
    "research scientist",
)

SENIOR_WORDS = (
    "senior",
    "sr ",
    "sr.",
    "staff",
    "principal",
    "lead ",
    "manager",
    "director",
    "head of",
    "vice president",
    "vp ",
    "distinguished",
    "architect",
    "level 5",
    "level 6",
    "level 7",
    "l5",
    "l6",
    "l7",
)

MID_LEVEL_TITLE_PATTERN = (
    r"\b(?:software engineer|software developer|frontend engineer|backend engineer"
    r"|full stack engineer|fullstack engineer|product engineer|engineer)\s+(?:ii|iii|iv|v)\b"
)
NON_ENTRY_TITLE_PATTERN = r"\b(?:experienced|mid[- ]level)\b|,\s*mid\b"
EXPERIENCE_PATTERN = r"\b([3-9]|\d{2,})\+?\s+years?\b"
ENTRY_TEXT_PATTERN = (
    r"\b(0-2|0 to 2|1-2|1 to 2)\s+years?\b"
    r"|\b(entry level|entry-level|recent graduate|new grad|university graduate)\b"
)

# --- Fixed values: locations ----------------------------------------------------------------

NON_US_PLACES = (
    "canada",
    "toronto",
    "vancouver",
    "montreal",
    "united kingdom",
    "uk",
    "london",
    "poland",
    "warsaw",
    "india",
    "israel",
    "tel aviv",
    "australia",
    "china",
    "singapore",
    "japan",
    "germany",
    "france",
    "spain",
    "netherlands",
    "ireland",
    "brazil",
    "mexico",
    "argentina",
    "emea",
    "apac",
    "latam",
    "europe",
)

US_WORDS = ("united states", "united states only", "usa", "u.s.", "u.s.a.", "us-only", "u.s.-only")

US_METRO_SHORTHANDS = ("sf", "nyc", "la")

US_STATE_NAMES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas",
    "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey",
    "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas",
    "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
    "district of columbia",
)

US_STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL",
    "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE",
    "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT",
    "VA", "VT", "WA", "WI", "WV", "WY",
)
US_STATE_CODE_PATTERN = r",\s*([A-Z]{2})(?:\b|,)"

REMOTE_WORDS = ("remote", "hybrid", "distributed", "work from home")

# Words that make the tail of a title look like a place.
TITLE_PLACE_WORDS = (
    "remote",
    "united states",
    "usa",
    "u.s.",
    "california",
    "new york",
    "washington",
    "texas",
    "massachusetts",
    "illinois",
    "georgia",
    "florida",
    "virginia",
    "los angeles",
    "san francisco",
    "new york city",
    "seattle",
    "austin",
    "boston",
    "chicago",
    "atlanta",
    "toronto",
    "vancouver",
    "london",
    "hyderabad",
    "berlin",
    "india",
    "canada",
    "united kingdom",
)
TITLE_SPLIT_MARKERS = ("early career", "new grad", "new graduate", "entry level", "entry-level")
ANCHOR_MARKERS = ("early career", "new grad", "entry level", "entry-level")

# --- Fixed values: hosts, links, URL keys ---------------------------------------------------

FEED_AGGREGATORS = ("indeed.com", "linkedin.com", "glassdoor.com", "ziprecruiter.com", "jobright.ai")

SEARCH_AGGREGATORS = (
    "linkedin.com",
    "indeed.com",
    "glassdoor.com",
    "ziprecruiter.com",
    "simplyhired.com",
    "monster.com",
    "careerbuilder.com",
    "dice.com",
    "builtin.com",
    "wellfound.com",
    "levels.fyi",
    "handshake.com",
    "joinhandshake.com",
    "google.com",
    "bing.com",
    "ihiretechnology.com",
    "remoterocketship.com",
)

BOARD_LINK_HOSTS = (
    "boards.greenhouse.io",
    "jobs.lever.co",
    "jobs.ashbyhq.com",
    "jobs.smartrecruiters.com",
    "myworkdayjobs.com",
)
JOB_LINK_PATHS = ("/job", "/jobs", "/career", "/careers", "/openings", "/positions")

BOARD_LINK_PATTERNS = {
    "greenhouse": r"https?://(?:boards|job-boards)\.greenhouse\.io/([A-Za-z0-9_-]+)",
    "lever": r"https?://jobs\.lever\.co/([A-Za-z0-9_-]+)",
    "ashby": r"https?://jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)",
    "smartrecruiters": r"https?://jobs\.smartrecruiters\.com/([A-Za-z0-9_-]+)",
}

TRACKING_KEYS = (
    "embed",
    "gh_src",
    "source",
    "ref",
    "referrer",
    "utm_campaign",
    "utm_content",
    "utm_medium",
    "utm_source",
    "utm_term",
)
TRACKING_PREFIX = "utm_"

# --- Fixed values: facts in descriptions ----------------------------------------------------

SALARY_PATTERN = (
    r"(?:USD\s*)?\$\s?\d{2,3}(?:,\d{3})?(?:\.\d{2})?"
    r"(?:\s*(?:-|to|–|—)\s*(?:USD\s*)?\$?\s?\d{2,3}(?:,\d{3})?(?:\.\d{2})?)?"
    r"(?:\s*(?:per\s+year|annually|/\s*(?:year|yr|hour|hr)))?"
)
DEADLINE_PATTERN = (
    r"(?:apply\s+by|application\s+deadline|deadline)\s*[:\-]?\s*"
    r"([A-Z][a-z]+\s+\d{1,2}(?:,\s*\d{4})?|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"
)
GRADUATION_PATTERN = r"\b(?:class\s+of|graduat(?:e|ing|ion)[^\d]{0,20})(20\d{2})\b"

# A text without any of these words cannot match the pattern of the same name.
SALARY_GUARD = ("$",)
DEADLINE_GUARD = ("deadline", "apply")
GRADUATION_GUARD = ("graduat", "class")
YEARS_GUARD = ("year",)

UNSPECIFIED = "Not specified"
REMOTE_TEXT_WORDS = ("fully remote", "remote role")
HYBRID_WORDS = ("hybrid",)
ONSITE_WORDS = ("on-site", "onsite", "in office", "in-office")
NO_SPONSOR_WORDS = (
    "no visa sponsorship",
    "cannot provide visa sponsorship",
    "unable to sponsor",
    "will not sponsor",
    "does not sponsor",
    "without sponsorship now or in the future",
)
SPONSOR_WORDS = ("visa sponsorship available", "sponsorship is available", "will sponsor")
# Every sponsorship or clearance text above or below holds its "mentions" word.
MENTIONS_SPONSOR_WORDS = ("sponsor",)
CITIZEN_WORDS = (
    "must be a u.s. citizen",
    "must be a us citizen",
    "u.s. citizenship required",
    "us citizenship required",
)
US_PERSON_WORDS = ("u.s. person", "us person")
ACTIVE_CLEARANCE_WORDS = ("active security clearance", "current security clearance")
ELIGIBLE_CLEARANCE_WORDS = (
    "ability to obtain a security clearance",
    "eligible for a security clearance",
)
MENTIONS_CLEARANCE_WORDS = ("security clearance",)

# --- Fixed values: scoring ------------------------------------------------------------------

SKILL_WORDS = {
    "Python": ("python",),
    "TypeScript": ("typescript",),
    "JavaScript": ("javascript",),
    "Java": ("java",),
    "C++": ("c++", "cpp"),
    "SQL": ("sql",),
    "React": ("react",),
    "Next.js": ("next.js", "nextjs"),
    "Node.js": ("node.js", "nodejs", "node "),
    "FastAPI": ("fastapi",),
    "Flask": ("flask",),
    "Express": ("express",),
    "Docker": ("docker",),
    "GitHub Actions": ("github actions",),
    "REST APIs": ("rest api", "restful"),
    "Apollo Client": ("apollo",),
    "MUI": ("mui", "material ui"),
    "Zustand": ("zustand",),
    "Pydantic": ("pydantic",),
    "Selenium": ("selenium",),
    "Langfuse": ("langfuse",),
    "Retrieval-Augmented Generation": (
        "retrieval-augmented generation",
        "retrieval augmented generation",
        "rag pipeline",
    ),
    "Model Context Protocol": ("model context protocol", "mcp server"),
    "Kubernetes": ("kubernetes", "k8s"),
    "Go": ("golang", " go "),
    "Rust": ("rust",),
    "Ruby": ("ruby", "rails"),
    "AWS": ("aws", "amazon web services"),
    "GCP": ("gcp", "google cloud"),
}

HIGH_BAR_COMPANIES = (
    "OpenAI",
    "Anthropic",
    "Stripe",
    "Meta",
    "Google",
    "Apple",
    "Databricks",
    "Snowflake",
    "Datadog",
    "Palantir",
    "NVIDIA",
)

ROLE_TAG_WORDS = {
    "frontend": ("frontend", "front end", "ui engineer"),
    "backend": ("backend", "back end", "api"),
    "full_stack": ("full stack", "full-stack"),
    "product_engineering": ("product engineer", "product engineering"),
    "new_grad": ("new grad", "university graduate", "recent graduate", "class of 2027"),
}
ENTRY_TAG_WORDS = ("software engineer i", "associate software engineer", "entry level")

MISMATCH_WORDS = (
    "firmware",
    "embedded",
    "data analyst",
    "it support",
    "site reliability",
    "sre",
    "devops",
    "research scientist",
)

REQUIRED_YEARS_PATTERN = (
    r"\b(?:at least|minimum(?: of)?|requires?|required|must have|with)\s+"
    r"(\d{1,2})\+?\s+years?\b|"
    r"\b(\d{1,2})\+?\s+years?\s+of\s+"
    r"(?:professional\s+|relevant\s+|industry\s+|software(?: development)?\s+)?experience\b"
)
MAX_PLAUSIBLE_YEARS = 15

# Fit: word groups with their points.
FIT_ROLE_WORDS = ("software engineer", "software developer", "product engineer")
FIT_FRONTEND_WORDS = ("frontend", "front end", "react", "next.js")
FIT_BACKEND_WORDS = ("backend", "back end", "api", "node", "python")
FIT_GRADUATE_WORDS = ("new grad", "university graduate", "recent graduate", "new college graduate")
FIT_COHORT_WORD = "2027"
FIT_JUNIOR_YEARS_WORDS = ("0-1 years", "0 to 1 years", "1 year", "new college graduate")
FIT_ENTRY_WORDS = ("early career", "entry level", "engineer i", "associate software engineer")
FIT_PRODUCT_WORDS = ("api", "web application", "customer", "product", "frontend", "backend")
FIT_EXPERIENCE_WORDS = ("collaborate", "ship", "customer-facing")
FIT_SENIOR_TITLE_WORDS = ("senior", "staff", "lead", "principal")
FIT_EXPLICIT_ENTRY_WORDS = (
    "new grad",
    "new graduate",
    "recent graduate",
    "university graduate",
    "early career",
    "entry level",
    "entry-level",
)
FIT_TARGET_YEAR_ROLES = ("associate", "software engineer", "software developer")

FIT_LABELS = {
    "role_match": "role type matches your target",
    "graduation_match": "explicitly targets new grads / class of 2027",
    "entry_level_signal": "entry-level signal present",
    "skill_overlap": "strong skill overlap",
    "product_profile": "product-focused engineering role",
    "experience_signal": "experience signals align",
    "location_match": "location matches your preference",
    "seniority_match": "no seniority red flags",
    "brand_bonus": "priority company",
    "explicit_entry_floor": "explicitly labeled as an entry-level role",
}

# Difficulty: word groups with their points.
DIFFICULTY_NICHE_WORDS = ("distributed systems", "compiler", "security engineering", "graphics", "c++")
DIFFICULTY_CROWD_WORDS = ("new grad", "entry level", "university graduate", "recent graduate")
DIFFICULTY_INTERVIEW_WORDS = ("leetcode", "algorithm", "data structures", "system design")
DIFFICULTY_VAGUE_WORDS = ("undefined", "various teams", "multiple product areas")

DIFFICULTY_LABELS = {
    "baseline": "standard entry-level bar",
    "company_bar": "competitive / selective employer",
    "niche_requirements": "niche technical requirements",
    "missing_skills": "some skill gaps detected",
    "competition": "high expected applicant volume",
    "interview_bar": "rigorous technical interview signal",
    "ambiguity": "role scope is unclear",
}

# --- Fixed values: short-item watch ---------------------------------------------------------

JOB_TERMS = (
    "apply",
    "application",
    "career",
    "early career",
    "engineer",
    "hiring",
    "intern",
    "job",
    "new grad",
    "opening",
    "recruit",
    "software",
    "swe",
)
FREE_TEXT_URL_PATTERN = (
    r"(?:https?://|www\.)[^\s<>()\[\]{}]+"
    r"|\b(?:[a-z0-9-]+\.)+(?:ai|app|careers|com|dev|io|jobs|net|org)(?:/[^\s<>()\[\]{}]*)?"
)
INTERN_TITLE_PATTERN = r"\b(?:intern(?:ship)?|co[- ]?op)\b"
CHALLENGE_WORDS = ("just a moment", "cf-chl", "captcha")

# --- Fixed values: enrichment ---------------------------------------------------------------

ENRICH_TITLE_WORDS = (
    "2027",
    "new grad",
    "new graduate",
    "university grad",
    "college grad",
    "early career",
)

# --- Lifecycle vocabulary -------------------------------------------------------------------

NEW, SEEN, REOPENED = "new", "seen", "reopened"
SAVED, APPLIED, IGNORED = "saved", "applied", "ignored"
USER_STATES = (SAVED, APPLIED, IGNORED)
ACTIONABLE = (NEW, REOPENED)
APPLY_NOW, APPLY_IF_INTERESTED, LOW_PRIORITY, SKIP = (
    "apply_now",
    "apply_if_interested",
    "low_priority",
    "skip",
)


@dataclass(frozen=True)
class Filters:
    """Location and role filters of one deployment."""

    allowed_locations: tuple[str, ...] = ("United States", "Remote")
    excluded_locations: tuple[str, ...] = ()
    excluded_families: tuple[str, ...] = ()
    target_year: int = 2027


@dataclass(frozen=True)
class Profile:
    """The person the listings are scored for."""

    graduation_year: int = 2027
    skills: tuple[str, ...] = ()
    preferred_locations: tuple[str, ...] = ("United States", "Remote")
    internships: tuple[str, ...] = ()


@dataclass(frozen=True)
class Thresholds:
    """Digest and alert cut-offs."""

    digest_min_fit: int = 65
    top_priority_fit: int = 80
    high_signal_fit: int = 65
    max_digest_jobs: int = 10
    alert_fit: int = 92


@dataclass(frozen=True)
class Limits:
    """Limits of a run. Caps on what is collected are off (None) unless a user sets them; what a cap
    leaves out is counted per collector."""

    max_jobs_per_source: int | None = None
    max_company_pages: int | None = None
    max_search_results: int | None = None
    max_enrichments: int | None = None
    min_description_chars: int = 160
    max_age_days: int = 45
    digest_max_age_days: int = 7
    reopen_after_days: int = 7
    seen_retention: int = 2000
    scorer_min_fit: int = 50
    scorer_batch: int = 20
    feedback_min_samples: int = 3
    feedback_bound: int = 10


@dataclass(frozen=True)
class StructuredFeed:
    """Column mapping of a JSON or CSV feed."""

    name: str
    url: str = ""
    job_path: str = ""
    company_key: str = "company"
    title_key: str = "title"
    url_key: str = "url"
    location_key: str = "location"
    posted_at_key: str = "posted_at"
    description_key: str = "description"
    job_id_key: str = "job_id"
    closed_key: str = ""


@dataclass(frozen=True)
class Settings:
    """Everything a run needs besides its input tables."""

    filters: Filters = field(default_factory=Filters)
    profile: Profile = field(default_factory=Profile)
    thresholds: Thresholds = field(default_factory=Thresholds)
    limits: Limits = field(default_factory=Limits)
    priority_companies: tuple[str, ...] = ()
    subject_prefix: str = "[Listings]"
    recipient: str = ""
    send_empty_digest: bool = False
    # Buckets of the listing state; aim at some hundred megabytes per bucket.
    state_buckets: int = 64
    # Deltas of the listing state after which a run compacts it first.
    compact_after: int = 32
