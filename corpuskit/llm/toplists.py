"""Vectors by id, blocks of them as matrices, tiles of blocks, and a tree of merges of per-query top lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lists merged by one task for one query at a time.
FAN_IN = 16
# Bytes of vectors of either side that meet in one task, at 8 a number, and the tiles that every core gets if it can.
TILE_BYTES = 1 << 25
TILES_A_CORE = 4
# Tasks of a shuffle of tiles at most; each takes one tile after the other.
TILE_TASKS = 2000


def usable(df: DataFrame, id_column: str, vector_column: str, zero: bool = True) -> DataFrame:
    """``(id, row, vec)`` of the rows that take part; ``row`` tells rows that repeat an id apart once it is written.

    Left out are null ids, null or empty vectors, vectors that hold null, NaN or an infinity and, unless ``zero``,
    vectors of zeros only.
    """
    vec = F.col(vector_column).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), vec.alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~bad)
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    return rows.select("id", F.monotonically_increasing_id().alias("row"), "vec")


def widest_group(vectors: DataFrame) -> tuple[int, int]:
    """``(dimension, rows)`` of the commonest vector length; the smaller one of equals, ``(0, 0)`` for no rows."""
    sizes = vectors.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.desc("n"), "dim").first()
    return (found["dim"], found["n"]) if found else (0, 0)


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all rows of whole numbers, exact, in the cheapest arithmetic that holds them; cut to 64 bits."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the ``k`` largest entries of every row; of equal ones the leftmost."""
    width = scores.shape[1]
    if width <= k:
        return np.ones(scores.shape, bool)
    edge = np.partition(scores, width - k, axis=1)[:, width - k, None]
    above = scores > edge
    level = scores == edge
    open_places = k - above.sum(axis=1, keepdims=True)
    return above | (level & (np.cumsum(level, axis=1) <= open_places))


def lists(picked: np.ndarray, scores: np.ndarray, ids: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row of ``(negated score, id)`` structs, for the entries that ``picked`` marks."""
    rows, columns = np.nonzero(picked)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(picked)))]).astype(np.int32)
    negated = pa.array(-scores[rows, columns], kind)
    values = pa.StructArray.from_arrays([negated, pa.array(ids[columns], pa.int64())], ["neg", "id"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def first_of(keys: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` entries of every key, sorted by key and then by ``order``."""
    at = np.lexsort((*reversed(order), keys))
    if not len(at):
        return at
    starts = np.flatnonzero(np.concatenate([[True], keys[at][1:] != keys[at][:-1]]))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[place < k]


def tile_sides(shards: int, blocks: int, shard_rows: int, block_rows: int, dim: int, cores: int) -> tuple[int, int]:
    """How many shards and how many blocks meet in one task.

    As many of both as ``TILE_BYTES`` holds, so that each side travels to few tasks, but so few that cores share the work.
    """
    shards_held, blocks_held = (max(1, TILE_BYTES // (8 * max(1, dim * rows))) for rows in (shard_rows, block_rows))
    block_side = min(blocks, blocks_held)
    shard_side = min(shards_held, max(1, shards * -(-blocks // block_side) // (TILES_A_CORE * cores)))
    if shard_side == 1:
        block_side = min(block_side, max(1, shards * blocks // (TILES_A_CORE * cores)))
    return shard_side, block_side


def tiles(left: DataFrame, right: DataFrame, keys: Sequence[str], count: int, work: Callable, schema: str) -> DataFrame:
    """``work`` on the rows of both sides with equal ``keys``, of which there are about ``count``.

    Both sides are shuffled whatever their sizes are: a join would send the smaller one, repeated for all tiles, to the
    driver wherever the plan takes it for a small table.
    """
    tasks = min(TILE_TASKS, 2 * count)
    left, right = (side.repartition(tasks, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def merged(tops: DataFrame, parts: int, k: int, fan_in: int = FAN_IN) -> DataFrame:
    """Lists ``(query_id, part, top)`` with ``part < parts`` to one sorted list of at most ``k`` per query.

    A level merges at most ``fan_in`` lists of one query, so no task gathers all lists of a query.
    """
    level = tops
    while True:
        every = F.array_sort(F.flatten(F.collect_list("top")))
        level = level.groupBy("query_id", F.floor(F.col("part") / fan_in).alias("part")).agg(
            F.slice(every, 1, k).alias("top")
        )
        parts = -(-parts // fan_in)
        if parts <= 1:
            return level.select("query_id", "top")


def ranked(lists_: DataFrame, queries: DataFrame, score: Column | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from sorted lists by the ``row`` of their query in ``queries (id, row)``."""
    named = lists_.withColumnRenamed("query_id", "row").join(queries.select("row", F.col("id").alias("query_id")), "row")
    rows = named.select("query_id", F.posexplode("top").alias("pos", "hit"))
    value = -F.col("hit.neg") if score is None else score
    return rows.select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), value.alias("score")
    )
