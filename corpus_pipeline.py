"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``; the last adds ``taken``, the
words the mix takes of the document (counting repeats). No SQL expresses the second stage, so the result is tested against
a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, mixing, neardup, pii, quality
from folioflow.llm._shared import shared_dir, table

ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines.

    Null or empty texts fail the rules and go; repeated rows share one verdict; extra columns are kept; an empty table gives no rows.
    """
    return quality.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id.

    Rows without words all stay; of repeated rows one stays, and rows that share a doc_id are apart if their texts are; extra columns are kept; an empty table gives no rows.
    """
    return neardup.representatives(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark words are cut out; documents that are mostly benchmark go.

    Null, empty and clean texts stay as they are; repeated rows are treated alike; extra columns are kept; an empty table gives no rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no row goes.

    Null, empty and clean texts stay as they are; of overlapping spans the first holds; extra columns are kept; an empty table gives no rows.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many words of each.

    Null or empty texts have no words and are not taken; a null source is a source; equal rows have equal takes; extra columns are kept; an empty table gives no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_text),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
