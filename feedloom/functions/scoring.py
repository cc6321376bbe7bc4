"""Scoring columns: skills, tags, fit, difficulty, recommendation and explanation.

The text is scanned once per distinct word (``words_in``); after that every rule is a set test
on a short array, and the groups stay visible as a struct so that a score can be explained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.text import (
    UNICODE,
    any_word,
    bind,
    has_any,
    job_text,
    materialize,
    quote,
    words_found,
    words_in,
)

TEXT_WORDS = tuple(
    dict.fromkeys(
        [
            *(word for words in rules.SKILL_WORDS.values() for word in words),
            *(word for words in rules.ROLE_TAG_WORDS.values() for word in words),
            *rules.ENTRY_TAG_WORDS,
            *rules.MISMATCH_WORDS,
            *rules.FIT_ROLE_WORDS,
            *rules.FIT_FRONTEND_WORDS,
            *rules.FIT_BACKEND_WORDS,
            *rules.FIT_GRADUATE_WORDS,
            rules.FIT_COHORT_WORD,
            *rules.FIT_JUNIOR_YEARS_WORDS,
            *rules.FIT_ENTRY_WORDS,
            *rules.FIT_PRODUCT_WORDS,
            *rules.FIT_EXPERIENCE_WORDS,
            *rules.DIFFICULTY_NICHE_WORDS,
            *rules.DIFFICULTY_CROWD_WORDS,
            *rules.DIFFICULTY_INTERVIEW_WORDS,
            *rules.DIFFICULTY_VAGUE_WORDS,
        ]
    )
)
TITLE_WORDS = tuple(
    dict.fromkeys(
        [*rules.FIT_SENIOR_TITLE_WORDS, *rules.FIT_EXPLICIT_ENTRY_WORDS, *rules.FIT_TARGET_YEAR_ROLES]
    )
)


# Rule groups are SQL texts over the scanned columns: one expression each, whatever their length.


def _found(words) -> str:
    return has_any("found", words)


def _points(condition: str, points: int) -> str:
    return f"if({condition}, {points}, 0)"


def _kept(texts: list[str]) -> str:
    return f"array_compact(array({', '.join(texts)}))"


def skill_list(owned: bool, profile: rules.Profile, limit: int = 6) -> Column:
    """First catalog skills found that are owned, or not owned, in catalog order."""
    names = [
        f"if({_found(words)}, {quote(skill)}, null)"
        for skill, words in rules.SKILL_WORDS.items()
        if (skill in profile.skills) == owned
    ]
    return F.expr(f"slice({_kept(names)}, 1, {limit})")


def role_tags(tier: str) -> Column:
    """Role words, remote, entry level, priority company and reach, sorted."""
    tags = [f"if({_found(words)}, {quote(tag)}, null)" for tag, words in rules.ROLE_TAG_WORDS.items()]
    tags += [
        "if(is_remote, 'remote', null)",
        f"if({_found(rules.ENTRY_TAG_WORDS)}, 'entry_level', null)",
        f"if({tier} = 1, 'priority_company', null)",
        "if(difficulty_score >= 70, 'reach', null)",
    ]
    return F.expr(f"array_sort({_kept(tags)})")


def required_years(text: Column) -> Column:
    """Largest plausible demand for years of experience, 0 without one."""
    demands = F.regexp_extract_all(text, F.lit(UNICODE + "(" + rules.REQUIRED_YEARS_PATTERN + ")"), F.lit(1))
    numbers = F.transform(demands, lambda d: F.regexp_extract(d, r"(\d{1,2})\+?\s+years?", 1).cast("int"))
    largest = F.array_max(F.filter(numbers, lambda v: v <= rules.MAX_PLAUSIBLE_YEARS))
    return F.when(any_word(text, rules.YEARS_GUARD), F.coalesce(largest, F.lit(0))).otherwise(F.lit(0))


def scan(df: DataFrame, profile: rules.Profile) -> DataFrame:
    """Add ``found`` (text words), ``title_found``, ``years``, ``prefers_place``: the only full scans."""
    lowered = materialize(
        df,
        _text=job_text(F.col("title"), F.col("description_text"), F.col("location_text")),
        _title=F.lower("title"),
        _place=F.lower(F.coalesce("location_text", F.lit(""))),
    )
    preferred = [p.lower() for p in profile.preferred_locations]
    return materialize(
        lowered.withColumn("found", words_in(F.col("_text"), TEXT_WORDS)),
        years=required_years(F.col("_text")),
        title_found=words_found("_title", TITLE_WORDS),
        prefers_place=F.col("is_remote") | any_word(F.col("_place"), preferred),
    ).drop("_text", "_title", "_place")


def fit_groups(tier: str) -> dict[str, str]:
    """Named point groups of the fit score, in the order in which they are explained."""
    heavy = f"({has_any('title_found', rules.FIT_SENIOR_TITLE_WORDS)} or years >= 5)"
    return {
        "role_match": f"{_points(_found(rules.FIT_ROLE_WORDS), 22)} + {_points(_found(rules.FIT_FRONTEND_WORDS), 5)}"
        f" + {_points(_found(rules.FIT_BACKEND_WORDS), 5)}",
        "graduation_match": f"{_points(_found(rules.FIT_GRADUATE_WORDS), 15)} + case"
        f" when array_contains(found, {quote(rules.FIT_COHORT_WORD)}) then 5"
        f" when {_found(rules.FIT_JUNIOR_YEARS_WORDS)} then 6 else 0 end",
        "entry_level_signal": _points(_found(rules.FIT_ENTRY_WORDS), 8),
        "skill_overlap": "least(18, size(top_matching_skills) * 3)",
        "product_profile": _points(_found(rules.FIT_PRODUCT_WORDS), 6),
        "experience_signal": _points(_found(rules.FIT_EXPERIENCE_WORDS), 2),
        "location_match": _points("prefers_place", 4),
        "seniority_penalty": f"case when {heavy} then -35 when years >= 2 then -18 else 0 end",
        "seniority_match": f"case when {heavy} or years >= 2 then 0 else 4 end",
        "role_penalty": _points(_found(rules.MISMATCH_WORDS), -40),
        "brand_bonus": f"case {tier} when 1 then 3 when 2 then 2 else 0 end",
    }


def entry_floor(profile: rules.Profile) -> str:
    """Lowest fit of a title that says it is entry level; 0 without such a title, null on a mismatch."""
    return (
        f"case when {_found(rules.MISMATCH_WORDS)} then null"
        f" when {has_any('title_found', rules.FIT_EXPLICIT_ENTRY_WORDS)} then 65"
        f" when contains(title, '{profile.graduation_year}') and {has_any('title_found', rules.FIT_TARGET_YEAR_ROLES)} then 60"
        " else 0 end"
    )


def difficulty_groups(tier: str) -> dict[str, str]:
    """Named point groups of the difficulty score."""
    high_bar = ", ".join(quote(c) for c in rules.HIGH_BAR_COMPANIES)
    return {
        "baseline": "25",
        "company_bar": f"case when company_name in ({high_bar}) then 28 when {tier} = 1 then 14 when {tier} = 2 then 9 else 0 end",
        "niche_requirements": _points(_found(rules.DIFFICULTY_NICHE_WORDS), 12),
        "missing_skills": "least(20, size(missing_or_weaker_skills) * 4)",
        "competition": _points(_found(rules.DIFFICULTY_CROWD_WORDS), 10),
        "interview_bar": _points(_found(rules.DIFFICULTY_INTERVIEW_WORDS), 8),
        "ambiguity": _points(_found(rules.DIFFICULTY_VAGUE_WORDS), 5),
        "match_discount": _points("size(top_matching_skills) >= 5", -5),
    }


def _struct(groups: dict[str, str]) -> Column:
    return F.expr("named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in groups.items()) + ")")


def _total(column: str, groups: dict[str, str]) -> Column:
    return F.expr(" + ".join(f"{column}.{name}" for name in groups))


def _clip(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def _explain(column: str, names: list[str], labels: dict[str, str]) -> Column:
    texts = [f"if({column}.{name} > 0, {quote(labels.get(name, name))}, null)" for name in names]
    return F.expr(f"array_join({_kept(texts)}, '; ')")


def recommend(fit: Column, mismatch: Column) -> Column:
    return (
        F.when(mismatch, rules.SKIP)
        .when(fit >= 80, rules.APPLY_NOW)
        .when(fit >= 65, rules.APPLY_IF_INTERESTED)
        .when(fit >= 45, rules.LOW_PRIORITY)
        .otherwise(rules.SKIP)
    )


def mismatch_without_place(title: Column, description: Column) -> Column:
    """Mismatch test on title and description only, used when a score is adjusted later."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))))
    return bind(text, lambda low: any_word(low, rules.MISMATCH_WORDS))


def score(df: DataFrame, profile: rules.Profile, tier: str = "company_tier") -> DataFrame:
    """Add the rule-based ranking of every listing; map-only.

    Needs title, description_text, location_text, is_remote, company_name and the tier column.
    """
    scanned = materialize(
        scan(df, profile),
        top_matching_skills=skill_list(True, profile),
        missing_or_weaker_skills=skill_list(False, profile),
    )
    fit, hard = fit_groups(tier), difficulty_groups(tier)
    grouped = materialize(
        scanned,
        fit_parts=_struct(fit),
        difficulty_parts=_struct(hard),
        floor=F.expr(entry_floor(profile)),
        mismatch=F.expr(_found(rules.MISMATCH_WORDS)),
    )
    raw_fit = _total("fit_parts", fit)
    lifted = F.when(F.col("floor") > raw_fit, F.col("floor") - raw_fit).otherwise(F.lit(0))
    scored = materialize(
        grouped,
        fit_groups=F.col("fit_parts").withField("explicit_entry_floor", lifted),
        fit_score=_clip(raw_fit + lifted),
        difficulty_score=_clip(_total("difficulty_parts", hard)),
    )
    fit_why = _explain("fit_groups", [*fit, "explicit_entry_floor"], rules.FIT_LABELS)
    hard_why = _explain("difficulty_parts", list(hard), rules.DIFFICULTY_LABELS)

    def sentence(kind: str, value: str, why: Column) -> Column:
        head = F.concat(F.lit(kind + " "), F.col(value).cast("string"), F.lit("/100 — "))
        return F.concat(head, F.when(why == "", "limited overlap with target profile").otherwise(why), F.lit("."))

    return scored.select(
        *df.columns,
        "fit_score",
        "difficulty_score",
        recommend(F.col("fit_score"), F.col("mismatch")).alias("recommendation"),
        sentence("Fit", "fit_score", fit_why).alias("fit_summary"),
        sentence("Difficulty", "difficulty_score", hard_why).alias("difficulty_summary"),
        "top_matching_skills",
        "missing_or_weaker_skills",
        role_tags(tier).alias("tags"),
        F.lit("heuristic").alias("scorer"),
        F.lit(0.78).alias("scorer_confidence"),
        F.col("fit_groups"),
        F.col("difficulty_parts").alias("difficulty_groups"),
    )
