"""Train/test splits that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import hash_fraction
from corpuskit.operators.ranking import hash_cutoff, within_cutoff


def _label(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train")


def split_exact(df: DataFrame, keys, test_size: float = 0.1, seed=0, out: str = "split") -> DataFrame:
    """Label exactly ``ceil(test_size * rows)`` rows as test; ``keys`` must identify a row."""
    cutoff = hash_cutoff(df, keys, seed, share=test_size)
    return df.withColumn(out, _label(within_cutoff(keys, seed, cutoff)))


def split_hash(df: DataFrame, keys, test_size: float = 0.1, seed=0, out: str = "split") -> DataFrame:
    """Label each row by its own hash: no pass over the table, usable on streams, size only approximate."""
    return df.withColumn(out, _label(hash_fraction(seed, *[F.col(k) for k in keys]) < F.lit(test_size)))


def split_by_group(df: DataFrame, group, test_size: float = 0.1, seed=0, out: str = "split") -> DataFrame:
    """Keep all rows of a group on one side, so windows or copies of a document cannot leak."""
    return split_hash(df, [group] if isinstance(group, str) else group, test_size, seed, out)


def parts(df: DataFrame, column: str = "split") -> tuple[DataFrame, DataFrame]:
    """The two sides as separate frames."""
    return (
        df.where(F.col(column) == "train").drop(column),
        df.where(F.col(column) == "test").drop(column),
    )
