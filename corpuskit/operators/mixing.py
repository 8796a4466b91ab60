"""Concatenating, weighting, permuting and sampling tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import hash_fraction, permutation_key
from corpuskit.operators.ranking import hash_cutoff, hash_position, within_cutoff

# Fixed value: rows in the largest batch drawn for length statistics.
SAMPLE_BATCH_ROWS = 1024 * 800


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, copies included; the frames must have the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def mixture(
    df: DataFrame, weights: Mapping[str, float], source: str = "source", keys=("doc_id",), seed=0, default: float = 1
) -> DataFrame:
    """Repeat every row as often as its source's weight says, numbered by ``copy_no``.

    The copies are made row by row in one scan. The fraction of a weight becomes an extra copy for that share
    of the rows, chosen by hash; a weight of 0 leaves the source out.
    """
    if min([default, *weights.values()]) < 0:
        raise ValueError("weights must not be negative")
    weight = F.lit(float(default))
    for name, value in weights.items():
        weight = F.when(F.col(source) == name, F.lit(float(value))).otherwise(weight)
    extra = hash_fraction(seed, *[F.col(k) for k in keys]) < weight - F.floor(weight)
    copies = (F.floor(weight) + extra.cast("int")).cast("int")
    return (
        df.withColumn("_copies", copies)
        .where("_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .drop("_copies")
    )


def shuffle(df: DataFrame, keys, seed=0) -> DataFrame:
    """A full permutation as a range-partitioned sort by hash; ``keys`` must identify a row."""
    return df.orderBy(permutation_key(seed, *[F.col(k) for k in keys]), *keys)


def shuffled_position(df: DataFrame, keys, seed=0, name: str = "position") -> DataFrame:
    """The place of each row in the permutation that :func:`shuffle` writes."""
    return hash_position(df, keys, seed, name)


def sample_n(df: DataFrame, n: int, keys, seed=42, strict: bool = True) -> DataFrame:
    """The first ``n`` rows of the permutation, as a row-wise filter on an exact hash cut-off."""
    return df.where(within_cutoff(keys, seed, hash_cutoff(df, keys, seed, n=n, strict=strict)))


def sample_batch(df: DataFrame, keys, n: int = SAMPLE_BATCH_ROWS, seed=42) -> DataFrame:
    """One random batch of at most ``n`` rows."""
    return sample_n(df, n, keys, seed, strict=False)
