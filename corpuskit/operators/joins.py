"""A lookup join that keeps hot keys from weighing down one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# So many of the most frequent keys are joined by broadcast. Every other key then holds less than 1/HOT_KEYS of
# the rows, however the rows are distributed.
HOT_KEYS = 1000
_SPREAD = 1 << 20


def hot_keys(df: DataFrame, on, limit: int = HOT_KEYS) -> DataFrame:
    """The ``limit`` most frequent keys; counted map-side, and each task hands on at most ``limit`` rows."""
    counted = df.groupBy(*on).agg(F.count("*").alias("_n"))
    return counted.orderBy(F.desc("_n"), *on).limit(limit).select(*on)


def lookup_split(rows: DataFrame, table: DataFrame, on, hot_rows: DataFrame) -> DataFrame:
    """Left-join ``table`` (unique on ``on``) to ``rows``, which are read twice; rows with a hot key are not shuffled.

    ``hot_rows`` are the table rows of the hot keys, bounded and written: they go out by broadcast. The other rows are
    shuffled as they are and get their values behind the shuffle, so wide values never reach the disk.
    """
    on = list(on)
    columns = [*rows.columns, *[c for c in table.columns if c not in on]]
    near = rows.join(F.broadcast(hot_rows), on)
    far = rows.join(F.broadcast(hot_rows.select(*on)), on, "left_anti").join(table, on, "left")
    return near.select(*columns).unionByName(far.select(*columns))


def lookup_join(rows: DataFrame, table: DataFrame, on, hot: DataFrame | None = None) -> DataFrame:
    """Left-join ``table`` (unique on ``on``) to distinct ``rows``, evaluating ``rows`` once.

    The table rows of the at most ``HOT_KEYS`` hot keys are broadcast. In the shuffle join that follows, rows with
    a hot key carry a salt from their own hash: it spreads them evenly and matches nothing, since they have their
    values already. ``hot`` spares the counting pass when the caller knows the hot keys.
    """
    on = list(on)
    added = [c for c in table.columns if c not in on]
    hot = hot_keys(rows, on) if hot is None else hot
    early = hot.join(table, on, "left").select(
        *on, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in added]
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(_SPREAD)) + 1).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(early), on, "left").withColumn("_salt", salt.cast("bigint"))
    # Always 0, but no literal: a literal would be folded out of the join keys and the salt with it.
    unsalted = F.pmod(F.xxhash64(*on), F.lit(1)).cast("bigint")
    joined = salted.join(table.withColumn("_salt", unsalted), [*on, "_salt"], "left")
    values = [F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in added]
    return joined.select(*rows.columns, *values)
