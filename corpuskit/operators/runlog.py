"""Checks over training logs ``(run, step, loss)``.

A run may be arbitrarily long, so no window spans a whole run: steps are cut into blocks of ``width`` step numbers,
windows run inside the blocks, and a small per-block summary carries over what a block needs from those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.ranking import global_rank

BLOCK_STEPS = 1 << 16


def _blocked(df: DataFrame, step: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(step) / width))


def new_best(df: DataFrame, run="run", step="step", loss="loss", width: int = BLOCK_STEPS) -> DataFrame:
    """Add ``prev_best``, the least earlier loss, and ``is_best`` where the loss is below it."""
    blocked = _blocked(df, step, width)
    inside = Window.partitionBy(run, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        blocked.groupBy(run, "_block")
        .agg(F.min(loss).alias("_min"))
        .select(F.col(run).alias("_run"), F.col("_block").alias("_at"), F.min("_min").over(across).alias("_before"))
    )
    same = F.col(run).eqNullSafe(F.col("_run")) & F.col("_block").eqNullSafe(F.col("_at"))
    best = F.least(F.min(loss).over(inside), F.col("_before"))
    return (
        blocked.join(before, same)
        .withColumn("prev_best", best)
        .withColumn("is_best", F.when(F.col("prev_best") > F.col(loss), 1).otherwise(0))
        .drop("_block", "_before", "_run", "_at")
    )


def spike(df: DataFrame, run="run", step="step", loss="loss", width: int = BLOCK_STEPS) -> DataFrame:
    """Add the two previous losses and ``is_spike`` where the rise exceeds the size of the change before it."""
    inside = Window.partitionBy(run, "_block").orderBy(step)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (
        _blocked(df, step, width)
        .withColumn("prev1", F.lag(loss, 1).over(inside))
        .withColumn("prev2", F.lag(loss, 2).over(inside))
        .withColumn("_at", F.row_number().over(inside))
        .withColumn("_size", F.count("*").over(whole))
    )
    # The two first rows of a block look back across its edge; the two first and two last rows of all blocks
    # are enough to find what they see.
    edges = Window.partitionBy(run).orderBy(step)
    first = (
        placed.where((F.col("_at") <= 2) | (F.col("_at") > F.col("_size") - 2))
        .withColumn("prev1", F.lag(loss, 1).over(edges))
        .withColumn("prev2", F.lag(loss, 2).over(edges))
        .where(F.col("_at") <= 2)
    )
    rises = F.col(loss) - F.col("prev1") > F.abs(F.col("prev1") - F.col("prev2"))
    return (
        placed.where(F.col("_at") > 2)
        .unionByName(first)
        .withColumn("is_spike", F.when(rises, 1).otherwise(0))
        .drop("_block", "_at", "_size")
    )


def every(df: DataFrame, n: int, step="step", shift: int = 0) -> DataFrame:
    """Rows whose step number plus ``shift`` is a multiple of ``n``."""
    return df.where((F.col(step) + shift) % n == 0)


def trial_summary(logs: DataFrame, configs: DataFrame | None = None, run="run", step="step", loss="loss") -> DataFrame:
    """Least, last and mean loss per run, ranked by the least loss, beside its configuration where there is one."""
    summary = logs.groupBy(run).agg(
        F.count("*").alias("n_steps"),
        F.min(loss).alias("min_loss"),
        F.max_by(loss, step).alias("last_loss"),
        F.avg(loss).alias("mean_loss"),
    )
    if configs is not None:
        summary = summary.join(configs, run, "left")
    return global_rank(summary, [F.asc("min_loss"), F.asc(run)])
