"""The queries of this subpackage over the driver's tables, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm import bpe, chat, containment, fingerprint, html, icws, lines, oracles, quality, sentences, suffix

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(_table(spark, sf_dir, "documents"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_substrings(_table(spark, sf_dir, "documents"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.format_digests(rows.unionByName(probe))


def span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.remove_repeated_spans(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": near_duplicates,
    "op2_decontamination": decontamination,
    "op3_byte_bpe": byte_bpe,
    "op4_line_dedup": line_dedup,
    "op5_html_text": html_text,
    "op6_quality": quality_scores,
    "op7_fingerprints": fingerprints,
    "op8_suffix_dedup": suffix_dedup,
    "op9_chat_format": chat_format,
    "op10_span_dedup": span_dedup,
}

#: The others can't be put in SQL; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op2_decontamination": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
     b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
     k as (select item_id, least(len(w), 5) as n, w from b where len(w) > 0),
     i as (select distinct item_id, n as width, array_to_string(w[p : p + n - 1], ' ') as s from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as p from k)),
     m as (select item_id, width, count(*) as n_shingles from i group by all),
     g as (select distinct doc_id, width, array_to_string(w[p : p + width - 1], ' ') as s
           from (select doc_id, width, w, unnest(range(1, len(w) - width + 2)) as p from d, (select distinct width from i) where len(w) >= width)),
     c as (select doc_id, item_id, count(*) as n_shared from g join i using (width, s) group by all)
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles as containment from c join m using (item_id) where n_shared >= 0.8 * n_shingles - 1e-9
""",
    "op4_line_dedup": oracles.LINES,
    "op8_suffix_dedup": oracles.SUFFIXES,
    "op9_chat_format": oracles.CHAT,
    "op10_span_dedup": oracles.SPANS,
}
