"""Descriptions for sparse new listings, taken from landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import rules
from feedloom.functions.details import job_details
from feedloom.functions.text import any_word, bind
from feedloom.operators.normalize import content_hash
from feedloom.runtime import fits_broadcast
from feedloom.sources.html import page_facts
from feedloom.sources.pages import best_description


def pick_sparse(listings: DataFrame, limits: rules.Limits) -> DataFrame:
    """The sparse listings worth a look; with a limit, explicit titles first, then the latest ones."""
    sparse = listings.filter(F.length("description_text") < limits.min_description_chars)
    if limits.max_enrichments is None:
        return sparse
    explicit = bind(F.lower("title"), lambda low: any_word(low, rules.ENRICH_TITLE_WORDS))
    return sparse.orderBy(
        explicit.desc(), F.col("posted_at").isNotNull().desc(), F.col("posted_at").desc(), "source_ordinal", "position"
    ).limit(limits.max_enrichments)


def _small(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast only if it was counted and is small."""
    return F.broadcast(df) if fits_broadcast(df) else df


def found_descriptions(picked: DataFrame, pages: DataFrame) -> DataFrame:
    """Text per canonical key; page bodies that no key asks for are dropped before any is parsed."""
    keys = picked.select("canonical_key", F.col("apply_url").alias("url"))
    wanted = pages.join(_small(keys.select("url").distinct()), "url", "left_semi")
    texts = best_description(page_facts(wanted.select("page_id", "url", "html")))
    longest = texts.groupBy("url").agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("page_id"))).alias("found")
    )
    return longest.join(_small(keys), "url").select("canonical_key", "found")


def patch_descriptions(listings: DataFrame, found: DataFrame, limits: rules.Limits) -> DataFrame:
    """Replace text, hashes and facts where a long enough description was found."""
    usable = found.filter(F.length("found") >= limits.min_description_chars)
    joined = listings.join(_small(usable), "canonical_key", "left")
    text = F.coalesce("found", "description_text")
    hit = F.col("found").isNotNull()
    patched = {
        "description_text": text,
        "description_hash": F.when(hit, F.sha2("found", 256)).otherwise(F.col("description_hash")),
        "content_hash": F.when(
            hit, content_hash(*[F.col(c) for c in ("company_name", "title", "location_text")], F.col("found"), F.col("apply_url"))
        ).otherwise(F.col("content_hash")),
        "job_details": F.when(
            hit, job_details(F.col("title"), F.col("found"), F.col("location_normalized"), F.col("is_remote"))
        ).otherwise(F.col("job_details")),
        "metadata": F.when(
            hit,
            F.map_zip_with(
                F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")),
                F.create_map(F.lit("description_enriched"), F.lit("true")),
                lambda _, old, new: F.coalesce(new, old),
            ),
        ).otherwise(F.col("metadata")),
    }
    return joined.select(*[patched[c].alias(c) if c in patched else F.col(c) for c in listings.columns])
