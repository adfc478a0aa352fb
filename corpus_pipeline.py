"""A corpus from raw documents: good quality, no repeated lines, no near copies, no benchmark passages, sources mixed to their weights.

Each stage is a function of (spark, docs, sf_dir); what it returns is written
as Parquet and read again as the next one's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelforge.llm import decontaminate, line_dedup, mixing, near_dup, quality
from parcelforge.llm.tables import discard, materialize, table

#: Words of a shingle for near copies.
SHINGLE = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores 0.7 or more, a null text as an empty one. Labels that train no network (none, or of one kind) reject nothing."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier elsewhere are taken out; documents of which no word is left go. Null, empty and blank texts stay as they are."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id; rows of one doc_id become one; documents without words or doc_id stay."""
    return near_dup.drop_near_duplicates(docs, k=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; an empty benchmark rejects nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of all documents, and how many of a document's words the mix takes, repeats counted (``taken``, 0 to 2 times ``size``), with its source's size and target. New names that clash get an underscore before them."""
    return mixing.mix_corpus(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
]

#: A trained network has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``. Extra columns go through, whatever they are called; empty tables give an empty corpus. Tables between the stages are deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = after
    return docs
