"""A corpus pipeline of five stages over ``documents``: the classifier's rejects go, repeated lines go, one of each group of near duplicates
stays, documents that hold a benchmark item go, and what is left is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm import bpe, containment, icws, lines, quality
from factspark.llm.queries import vocabulary_path
from factspark.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on this input, rejects go; a null text is scored as an empty one, equal texts alike; a score at the bound stays."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; n_chars is that of the text that is left. A line by itself goes from five words on, so that documents of a
    word or two, which others hold by chance, aren't emptied."""
    return lines.dedup_lines(docs, carry=True, least_words=5).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least id; of an id with several texts only the one that is in the class goes."""
    return icws.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, every row of such an id; a null text or item holds nothing, and rows without an id count as one id."""
    return containment.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row; a null text has no token."""
    return bpe.round_trip(docs, vocabulary_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

#: Expectation-maximisation and BPE can't be put in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written to the shared folder before the next one reads it."""
    shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
