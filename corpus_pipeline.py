"""The corpus pipeline: language ID, near-duplicates, decontamination, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each to the shared scratch folder and reads it back as
the next one's documents. All but the last return the columns of the documents.

Null, empty, long and repeated texts, and columns with clashing names, are dealt with by the operators; see there. An empty
table passes all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontaminate, langid, mixing, near_copies, token_output
from feedloom.llm.common import landed, table

# A document whose most likely language has a lower posterior than this is rejected.
LEAST_POSTERIOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter, or undecided between languages, go."""
    return langid.keep_determined(docs, langid.train(docs), LEAST_POSTERIOR)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose 5-word shingles have a similarity of 0.8, that of the smallest doc_id.

    SimHash anchors propose pairs first, min-hash bands what lies beyond their 2 bits; whole shingle sets decide on both.
    """
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights; a document comes once for each epoch that holds it."""
    return mixing.mix_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Offsets of all documents in the files of token ids."""
    return token_output.tokenized(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

# Segmentation sums, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
