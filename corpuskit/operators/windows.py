"""Training examples from id arrays, as rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import sequences
from corpuskit.operators.ranking import exact_quantiles, global_rank


def segment(
    df: DataFrame, chunk: int = 512, seam: int = 5, ids: str = "ids", keys=("doc_id",), dedup_tail: bool = False
) -> DataFrame:
    """One row per window of :func:`sequences.segments`, numbered from 0 by ``chunk_no``."""
    windows = sequences.segments(F.col(ids), chunk, seam, dedup_tail)
    return df.select(*keys, F.posexplode(windows).alias("chunk_no", ids))


def tail(df: DataFrame, length: int = 512, ids: str = "ids") -> DataFrame:
    """Keep the last ``length`` ids of every row."""
    return df.withColumn(ids, sequences.tail(F.col(ids), length))


def row_pairs(df: DataFrame, order: Sequence[str], ids: str = "ids", batch: int = 1000) -> DataFrame:
    """Each row's id array beside the next row's, within consecutive batches of ``batch`` rows.

    ``order`` must be a total order. Only the order columns are ranked; a window never holds more than ``batch``
    rows.
    """
    ranked = global_rank(df.select(*order), [F.asc(c) for c in order])
    batch_no = F.floor((F.col("rank") - 1) / batch)
    following = F.lead(ids).over(Window.partitionBy("batch_no").orderBy("rank"))
    ranked = ranked.select("rank", *[F.col(c).alias(f"_rank_{c}") for c in order])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_rank_{c}")) for c in order])
    return (
        df.select(*order, ids)
        .join(ranked, same)
        .withColumn("batch_no", batch_no)
        .withColumn("next_ids", following)
        .where(F.col("next_ids").isNotNull())
        .select(*order, "batch_no", F.col(ids).alias("ids"), "next_ids")
    )


def _beside(df: DataFrame, first: Column, n: Column, offsets, ids: str, keys) -> DataFrame:
    """``n`` rows a list: ``pos`` from ``first`` and, as ``_0``, ``_1`` and so on, the ids at each offset from there.

    Shifted slices are zipped, which compiles; functions over arrays are interpreted. The list itself does not go along:
    behind an expression that does not compile it would be copied into every row.
    """
    names = [f"_{i}" for i in range(len(offsets))]
    shifted = [F.slice(ids, first + F.lit(o + 1), n) for o in offsets]
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "_row"))
    fields = rows.schema["_row"].dataType.names
    return rows.select(*keys, (first + F.col("pos")).alias("pos"), *[F.col("_row").getField(f).alias(name) for f, name in zip(fields, names)])


def adjacent_pairs(df: DataFrame, ids: str = "ids", keys=("doc_id",)) -> DataFrame:
    """Rows ``(pos, a, b)``: each id with its successor."""
    rows = _beside(df, F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), (0, 1), ids, keys)
    return rows.select(*keys, "pos", F.col("_0").alias("a"), F.col("_1").alias("b"))


def context_windows(df: DataFrame, offsets=(-1, 1), margin: int = 2, ids: str = "ids", keys=("doc_id",)) -> DataFrame:
    """Rows ``(pos, context, target)`` for every position far enough from both ends, the context in offset order."""
    if margin < max(abs(o) for o in offsets):
        raise ValueError("margin must cover all offsets")
    n = F.greatest(F.size(ids) - 2 * margin, F.lit(0))
    rows = _beside(df, F.lit(margin), n, (*offsets, 0), ids, keys)
    context = F.array(*[f"_{i}" for i in range(len(offsets))])
    return rows.select(*keys, "pos", context.alias("context"), F.col(f"_{len(offsets)}").alias("target"))


def causal_examples(df: DataFrame, ids: str = "ids", keys=("doc_id",), ignore_id: int | None = 4) -> DataFrame:
    """Input and label arrays shifted by one, and how many labels count."""
    labels = sequences.causal_labels(F.col(ids))
    counted = F.size(labels if ignore_id is None else F.filter(labels, lambda x: x != ignore_id))
    return df.select(
        *keys,
        sequences.causal_inputs(F.col(ids)).alias("input_ids"),
        labels.alias("label_ids"),
        counted.alias("n_labels"),
    )


def length_stats(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Row count and mean length, the latter also cut to a whole number."""
    size = F.size(ids)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min(size).alias("min_len"),
        F.max(size).alias("max_len"),
        F.avg(size).alias("mean_len"),
        F.avg(size).cast("bigint").alias("mean_len_int"),
    )


def length_quantiles(df: DataFrame, quantiles=(0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0), ids: str = "ids") -> DataFrame:
    """``(quantile, length)``: exact discrete quantiles of the sequence lengths; null where there are no rows.

    Jobs run while the result is planned.
    """
    found = exact_quantiles(df, F.when(F.col(ids).isNotNull(), F.size(ids)), quantiles)
    rows = [(float(q), length) for q, length in zip(quantiles, found)]
    return df.sparkSession.createDataFrame(rows, "quantile double, length int")
