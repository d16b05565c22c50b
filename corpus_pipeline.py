"""The corpus pipeline: quality classifier, quality rules, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of documents; the last returns a row for each packed piece.

In every stage an empty table gives an empty one, further columns of any name pass through unchanged (but for the last
stage), rows are never merged unless their stage says so, and texts are read whole. What a stage makes of nulls, empty
texts and repeats stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm import classifier, packing, quality_rules, secret_scan, similar
from tarnflow.llm.common import kept, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones among docs.

    Null and empty texts have the score of an empty text; repeated rows have equal scores and stay or go together; rows
    without a doc_id are scored like any others. Without labels of both classes all documents stay."""
    return classifier.keep(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules fail or whose statistics are outliers go.

    Null and empty texts fail the base rules; null lang and source are values of their own; repeated rows stay or go together."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least doc_id: texts of a
    similarity of 0.8 or more in shingles of five words, and chains of them.

    Null and empty texts are near-duplicates of each other alone. Repeated rows of a doc_id become one; texts of a repeated
    doc_id in different groups are judged each for itself. Rows without a doc_id stay."""
    return similar.keep(docs, similarity=0.8, shingle=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows; every document stays.

    Null texts stay null, empty ones empty; repeated rows are masked alike."""
    return secret_scan.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens.

    Null and empty texts are packed as the end id alone; repeated rows and rows without a doc_id like any others."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: SQL can't express any of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, f"stage-{name}")
    return docs
