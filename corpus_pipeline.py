"""From documents to packed training sequences: five stages, each written as Parquet and read by the next.

All stages keep extra columns, whatever their names, up to the last one.  Null and empty texts have no words, so the first stage rejects
them; the later stages, used alone, keep them.  A null doc_id is a document like others; repeated rows are copies of one
text.  Length is not limited anywhere, and an empty table goes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, jaccard_join, line_rules, packing, secret_scan
from quarry.llm.shared import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes common lines and rejects documents by the base rules or when they are depleted.

    Rows of one text, and groups of near copies, count once for what is common.  Rows of one text fare alike.
    """
    return line_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; five-word shingles, 80 of 100.

    Of rows with equal doc_ids the first one counts; a null doc_id comes after all others.  Rows without words all stay.
    """
    return jaccard_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty items are held by none, null and empty texts hold none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are replaced by their kind; n_chars follows.  No row goes; null stays null."""
    return secret_scan.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null or empty text is one piece of the end id alone."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
