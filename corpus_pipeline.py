"""Corpus pipeline: stages over the documents, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import decontamination, mixing, near_duplicates, quality_rules, token_files
from tallyglass.llm.common import parked, table
from tallyglass.llm.queries import mix_plan, with_domain
from tallyglass.session import scratch_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, of the smallest doc_id."""
    return near_duplicates.one_of_each_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt to domains, languages and sources by weight; a document may come twice."""
    return mixing.mixed(with_domain(docs), mix_plan(1.0)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b files; one row per document, read back from them."""
    import public_tokenizers

    folder = scratch_dir(spark, "corpus")
    manifest = token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(manifest, folder)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL cannot express the near-duplicate and the binary stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = parked(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
