"""Corpus pipeline: quality rules, near-duplicates, benchmark passages, source mix, token ids in training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, decontaminate, mixing, quality, simhash, tokens


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass every quality rule. Null and blank texts go; repeated rows stay or go together; empty docs give no rows."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: its smallest doc_id, a null id last, ties by text hash. Null and blank texts are
    one group; rows repeated in full give one row; very long texts are hashed whole; empty docs give no rows."""
    return simhash.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item, with or without an id. Null and blank texts stay; an empty benchmark keeps all."""
    return decontaminate.clean(docs, common.load(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them. Null sources are one source; documents without an id draw by their text."""
    return mixing.sample(docs)


def training_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids in training order. Null and empty texts add an end token; empty docs give no rows."""
    return tokens.materialise(docs)


STAGES = [
    ("quality_rules", rules),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", benchmark_passages),
    ("mix_sources", source_mix),
    ("token_ids", training_tokens),
]

ORACLE_SQL = None  # hashes and tokenisers have no SQL form; tests hold it against a plain Python version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
