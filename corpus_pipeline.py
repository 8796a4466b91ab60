"""Documents to packed training sequences: language, repeated lines, near copies, mix, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm import language, lines, mixture, overlap, packing
from corpuskit.session import configure, write_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def configured(stage: Stage) -> Stage:
    """The stage in a session that has the settings its memory relies on, also where it is run without ``run``."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run_stage


@configured
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and texts without a letter go."""
    return language.with_language(docs)


@configured
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; those left without any line go."""
    return lines.without_repeated_lines(docs)


@configured
def overlap_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return overlap.without_near_copies(docs)


@configured
def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixture.mix_documents(docs)


@configured
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", overlap_stage),
    ("source_mixing", mixture_stage),
    ("sequence_packing", packing_stage),
]

# Parsing with automata and tokenising have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), name).df
    return docs
