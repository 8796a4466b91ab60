"""Exact top-k by integer inner product: tiles of query blocks and shards, partial selection, a tree of merges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import toplists
from corpuskit.session import write_stage

SCALE = 64
TOP = 20
SHARD_ROWS = 1024
QUERY_ROWS = 256
_NARROW = float(2**31)
# The least score, and entries per query that are held beyond the best, in multiples of their number.
_LEAST = -(2**63) + 1
_LOOSE = 4

_BLOCK = "block int, ids binary, vecs binary, vec_bytes int"
_TOPS = "query_id bigint, part int, top array<struct<neg: bigint, id: bigint>>"
_HITS = pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64())]))
_NO_TOPS = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("top", _HITS)]).empty_table()


def _packed(group: pa.Table) -> pa.Table:
    """One block: its ids and row numbers in order and its matrix of whole numbers, in 4 bytes each where they fit."""
    group = group.sort_by([("id", "ascending"), ("row", "ascending")])
    ids = np.stack([group["id"].to_numpy(), group["row"].to_numpy()]).astype("<i8")
    vecs = toplists.matrix(group["q"])
    narrow = float(np.abs(vecs).max(initial=0)) < _NARROW
    block = group["block"][0].as_py()
    return pa.table(
        {
            "block": pa.array([block], pa.int32()),
            "ids": [ids.tobytes()],
            "vecs": [vecs.astype("<i4" if narrow else "<f8").tobytes()],
            "vec_bytes": pa.array([4 if narrow else 8], pa.int32()),
        }
    )


def _matrix(vecs: bytes, size: int, dim: int) -> np.ndarray:
    return np.frombuffer(vecs, "<i4" if size == 4 else "<f8").reshape(-1, dim)


def _blocks(vectors: DataFrame, count: int) -> DataFrame:
    """Rows dealt evenly over ``count`` blocks, each packed to one row."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_packed, _BLOCK)


def _tops(shards: pa.Table, asked: pa.Table, part: int, k: int, dim: int) -> Iterator[pa.Table]:
    """The best ``k`` of all shards for every query, block by block."""
    columns = ("ids", "vecs", "vec_bytes")
    shards = [
        (*np.frombuffer(ids, "<i8").reshape(2, -1), _matrix(vecs, size, dim)) for ids, vecs, size in zip(*(shards[c].to_pylist() for c in columns))
    ]
    for query_ids, query_vecs, query_size in zip(*(asked[c].to_pylist() for c in columns)):
        query_rows = np.frombuffer(query_ids, "<i8").reshape(2, -1)[1]
        queries = _matrix(query_vecs, query_size, dim)
        floor = np.full(len(query_rows), _LEAST)
        held, loose = [np.empty(0, np.int64) for _ in range(3)], []
        for number, (ids, rows, vecs) in enumerate(shards):
            scores = toplists.products(queries, vecs)
            # Scores are cut above the least long, so a query never finds its own row.
            scores[query_rows[:, None] == rows[None, :]] = np.iinfo(np.int64).min
            fit = scores >= floor[:, None]
            if fit.sum() > _LOOSE * k * len(floor):
                fit &= toplists.best(scores, k)
            query, at = np.nonzero(fit)
            loose.append((query, -scores[query, at], ids[at]))
            if sum(len(x[0]) for x in loose) > _LOOSE * k * len(floor) or number == len(shards) - 1:
                held = [np.concatenate(x) for x in zip(held, *loose)]
                first = toplists.first_of(held[0], k, *held[1:])
                held, loose = [x[first] for x in held], []
                size = np.bincount(held[0], minlength=len(floor))
                full = np.flatnonzero(size >= k)
                floor[full] = -held[1][np.cumsum(size)[full] - 1]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(held[0], minlength=len(floor)))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in held[1:]], ["neg", "id"])
        parts = pa.array(np.full(len(floor), part, np.int32))
        yield pa.table([pa.array(query_rows, pa.int64()), parts, pa.ListArray.from_arrays(pa.array(offsets), values)], ["query_id", "part", "top"])


def exact_top_k(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    queries: Column | None = None,
    k: int = TOP,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` largest integer inner products of every query with all other rows: ``(query_id, rank, vec_id, score)``.

    A component ``x`` counts as ``floor(scale * x)``. Queries are the rows that ``queries`` (a condition on ``id``)
    holds for, by default ids divisible by 20. Query blocks and shards of bounded rows meet once, each time in a matrix
    product and a partial selection; a tile is one task's many blocks and shards, which hands on one list a query, and a
    query's lists are merged in a tree. Ties go to the smaller id.

    Null ids, null or empty vectors, and vectors that hold null or non-finite components take no part; vectors of another
    length than the commonest neither. Rows that repeat an id are rows of their own, as queries too. Scores beyond a long
    are cut to its bounds. No rows give no rows; other columns are ignored. Jobs run while the result is planned.
    """
    queries = F.col("id") % 20 == 0 if queries is None else queries
    vectors = toplists.usable(df, id_column, vector_column)
    vectors = write_stage(vectors, "vectors").df
    dim, rows = toplists.widest_group(vectors)
    # floor() of Spark ends at 2^63; doubles beyond 2^53 are whole numbers.
    small = lambda x: F.abs(x * scale) < float(1 << 53)
    whole = F.transform("vec", lambda x: F.when(small(x), F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("q")
    vectors = vectors.where(F.size("vec") == dim)
    asked = vectors.where(queries)
    shards = max(1, math.ceil(rows / shard_rows))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    packed = write_stage(_blocks(vectors.select("id", "row", whole), shards), "shards").df
    asking = write_stage(_blocks(asked.select("id", "row", whole), blocks), "queries").df
    cores = df.sparkSession.sparkContext.defaultParallelism
    shard_side, block_side = toplists.tile_sides(shards, blocks, shard_rows, query_rows, dim, cores)
    parts, calls = math.ceil(shards / shard_side), math.ceil(blocks / block_side)
    columns = ["ids", "vecs", "vec_bytes"]
    left = packed.select(
        F.floor(F.col("block") / shard_side).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(calls - 1))).alias("call"), *columns
    )
    right = asking.select(
        F.floor(F.col("block") / block_side).cast("int").alias("call"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *columns
    )

    def tile(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return _NO_TOPS
        return pa.concat_tables(_tops(held, asked, held["part"][0].as_py(), k, dim))

    tops = toplists.tiles(left, right, ["part", "call"], parts * calls, tile, _TOPS)
    tops = toplists.merged(tops, parts, k)
    return toplists.ranked(tops, asked)
