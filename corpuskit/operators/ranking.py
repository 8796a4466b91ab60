"""Exact ranks and cut-offs without sending a whole table through one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import permutation_key
from corpuskit.session import write_stage

# Leading hex digits of the hash that form the histogram: 16**4 = 65,536 buckets at most.
_BUCKET_DIGITS = 4


def hash_cutoff(
    df: DataFrame, keys, seed, n: int | None = None, share: float | None = None, strict: bool = False
) -> str | None:
    """The permutation key of the last row among the first ``n`` (or ``ceil(share * rows)``) in hash order.

    ``keys`` must identify a row. Two small jobs find the value: a histogram over the leading hash digits
    (combined map-side, at most 65,536 rows), then the rows of the one bucket that holds the cut, about
    1/65,536 of the table. None means that no row is asked for; every later use is a row-wise comparison.
    ``strict`` raises when there are fewer than ``n`` rows.
    """
    hashed = df.select(permutation_key(seed, *[F.col(k) for k in keys]).alias("h"))
    bucket = F.substring("h", 1, _BUCKET_DIGITS)
    histogram = hashed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    cumulated = histogram.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = F.ceil(F.lit(share) * F.col("total")) if n is None else F.least(F.lit(n), F.col("total"))
    edge = (
        cumulated.withColumn("wanted", wanted.cast("bigint"))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select("bucket", "n", "total", (F.col("wanted") - F.col("upto") + F.col("n")).alias("need"))
        .first()
    )
    if strict and n and (edge is None or edge["total"] < n):
        raise ValueError(f"fewer than {n} rows")
    if edge is None:
        return None
    beyond = edge["n"] > edge["need"]
    taken = hashed.where(bucket == edge["bucket"]).orderBy("h").limit(edge["need"] + int(beyond))
    last = taken.groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("h")).limit(2).collect()
    if beyond and last[0]["n"] > 1:
        raise ValueError(f"{list(keys)} do not identify a row")
    return last[int(beyond)]["h"]


def within_cutoff(keys, seed, cutoff: str | None) -> Column:
    """Whether a row lies at or before the cut-off in hash order."""
    if cutoff is None:
        return F.lit(False)
    return permutation_key(seed, *[F.col(k) for k in keys]) <= F.lit(cutoff)


def hash_position(df: DataFrame, keys, seed, name: str = "position") -> DataFrame:
    """The exact place (from 1) of every row in hash order.

    Hash buckets have even sizes by construction, so each window partition stays small at any scale; the
    bucket offsets are at most 65,536 rows and are safe to broadcast.
    """
    order = permutation_key(seed, *[F.col(k) for k in keys])
    tagged = df.withColumn("_h", order).withColumn("_bucket", F.substring("_h", 1, _BUCKET_DIGITS))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        df.select(F.substring(order, 1, _BUCKET_DIGITS).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h"))
    return (
        tagged.withColumn("_in", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint"))
        .drop("_h", "_bucket", "_in", "_before")
    )


def global_rank(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Number all rows from 1 in any total order: range sort, then per-partition offsets.

    The sorted rows are written once, so the partition numbers in them cannot change between the two reads.
    The offsets have one row per sort partition.
    """
    tagged = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = write_stage(tagged, "rank").df
    part = F.shiftright("_at", 33)
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + row + 1).cast("bigint"))
        .drop("_part", "_at", "_before")
    )



# Bits of a value that one scan tells apart: a scan brings at most 2^16 counts a wanted quantile to the driver.
_DIGIT = 16


def quantile_places(total: int, quantiles) -> list[int]:
    """The place, from 0, of every discrete quantile among ``total`` sorted values."""
    return [max(1, total - math.floor(total - q * total)) - 1 for q in quantiles]


def exact_quantiles(df: DataFrame, value: Column, quantiles: Sequence[float]) -> list[int | None]:
    """The exact discrete quantiles of whole numbers from 0 to 2^31 - 1, without a sort.

    ``df`` is read once: its values are counted, combined in every task, and written. The first scan of what was written
    adds counts up by the high 16 bits, which gives the high bits of each quantile and its place among the values that
    share them. The second adds up the low 16 bits of those values alone. Nulls do not count; without values all
    quantiles are None.
    """
    values = df.select(value.cast("bigint").alias("v")).where("v IS NOT NULL")
    counted = write_stage(values.groupBy("v").agg(F.count("*").alias("n")), "values")
    high, added = F.shiftright("v", _DIGIT), F.sum("n").alias("n")
    counts = sorted((r["high"], r["n"]) for r in counted.df.groupBy(high.alias("high")).agg(added).collect())
    total = sum(n for _, n in counts)
    if not total:
        return [None] * len(quantiles)
    if counts[0][0] < 0 or counts[-1][0] >> 15:
        raise ValueError("values are from 0 to 2^31 - 1")
    wanted = []
    for place in quantile_places(total, quantiles):
        for digit, n in counts:
            if place < n:
                wanted.append((digit, place))
                break
            place -= n
    near = counted.df.where(high.isin(sorted({d for d, _ in wanted})))
    low = F.col("v").bitwiseAND((1 << _DIGIT) - 1)
    fine: dict[int, list] = {}
    for row in near.groupBy(high.alias("high"), low.alias("low")).agg(added).collect():
        fine.setdefault(row["high"], []).append((row["low"], row["n"]))
    counted.drop()
    found = []
    for digit, place in wanted:
        for rest, n in sorted(fine[digit]):
            if place < n:
                found.append(digit << _DIGIT | rest)
                break
            place -= n
    return found
