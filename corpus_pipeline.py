"""The corpus pipeline: each stage works on all that the one before kept.

Quality rules drop bad documents, MinHash near-dedup keeps one document of each
group (five-word shingles, similarity 0.8), decontamination drops documents
that hold a benchmark item, the secret scan blanks secrets, and mixing draws
the documents to target weights. Stages that end in a Python step store their
rows themselves, so that the step gets small batches whoever writes the result.
All stages but the last return the columns of
``documents``; the last returns one row a document with the words and copies
that the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verso.llm.common import stored, table
from verso.llm.decontaminate import decontaminate
from verso.llm.minhash import one_of_each
from verso.llm.mixing import plan_mix
from verso.llm.quality import quality_filter
from verso.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have no words and go; repeated rows are judged
    alike; very long texts are read whole; an empty table stays empty; all columns are kept."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, of equal ids the one with the smallest digest of
    the row. Of rows equal in all columns one stays. Null and empty texts are near to nothing and stay; null ids
    come last; very long texts are compared whole; an empty table stays empty; all columns are kept."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null, empty and shorter than five-word texts hold none and stay;
    repeated rows are judged alike; very long texts are read whole; empty tables are allowed; all columns are kept."""
    return stored(decontaminate(docs, table(spark, sf_dir, "benchmark")), "pipeline-clean")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets blanked in their texts. Null and empty texts stay as they are; repeated rows are treated
    alike; very long texts are read whole; an empty table stays empty; all columns are kept."""
    return stored(redact_secrets(docs), "pipeline-redacted")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document with the words and copies that the mix takes. Null texts count no words and are never taken;
    a null source is one of its own, sorted last; repeated rows are documents of their own; an empty table gives no rows."""
    return plan_mix(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: The secret scan's trained field has no SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
