"""The corpus pipeline: documents in, packed batches out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``. Other columns of ``docs``
come along, whatever their names, and nulls in any column are no error. An empty table
gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import saved, table
from tidemill.llm.langid import keep_identified
from tidemill.llm.minhash import NearDupRules, drop_near_duplicates
from tidemill.llm.mixing import label_domains, mix
from tidemill.llm.packing import pack
from tidemill.llm.secrets import mask_secrets

#: Five-word shingles at similarity 0.8; a pair there misses all bands with a chance of 3e-6.
NEAR_DUPLICATES = NearDupRules(width=5, percent=80, bands=24)
#: Shares of the token total that mixing aims at; it only repeats documents.
WEIGHTS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those whose prediction is ``und`` or not
    calibrated to be right often enough. A null, empty or blank text, or one without
    letters, has no language and goes. Texts count whole; equal texts fare alike. With no
    label to learn from nothing can be told, and all goes."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id.
    A text without words, and a row without doc_id, is in no group and stays; rows that
    share a doc_id stay or go together."""
    return drop_near_duplicates(docs, NEAR_DUPLICATES)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes. Null and empty texts stay as
    they are; rows are independent, so repeated ones fare alike."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at the rates that bring the domains to their targets; none goes,
    for rates are at least 1. A document without words, id or label counts by what the
    classifier says of it; without any label all rates are 1. How often a fractional rate
    repeats a row is drawn from a hash of its doc_id and text."""
    return mix(docs, label_domains(table(spark, sf_dir, "labels")), WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their place in token-budget batches, all of them: texts without words
    have length 0, one longer than the budget is alone, repeated rows each have a slot."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the trained and signature-based stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
