"""Approximate nearest neighbours by an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import toplists
from corpuskit.session import write_stage

TOP = 20
# Centroids per half; at most 64, so that the cells visited beside one centroid of the first half fit one integer.
CENTROIDS = 64
# Rows the centroids are fitted on.
SAMPLE_ROWS = 8192
# Share of all entries, and least number of them, that a query's cells hold together.
SHARE = 0.5
CANDIDATES = 2000
CELL_ROWS = 1024
QUERY_ROWS = 1024

_TOPS = "query_id bigint, part int, top array<struct<neg: double, id: bigint>>"


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    distance = (centres**2).sum(axis=1) - 2 * rows @ centres.T
    return distance.argmin(axis=1)


def fit_centres(rows: np.ndarray, count: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows; fewer where there are fewer distinct rows."""
    distinct = np.unique(rows, axis=0)
    order = np.random.default_rng(seed).permutation(len(distinct))[:count]
    centres = distinct[order].copy()
    for _ in range(rounds):
        cell = nearest(rows, centres)
        held = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        full = held > 0
        centres[full] = sums[full] / held[full, None]
    return centres


def visited(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> dict[int, int]:
    """Cells for one query, as a bit mask over the second half's centroids by centroid of the first half.

    ``first`` and ``second`` are distances to the centroids of each half. Pairs come off a heap by summed distance
    until the cells taken hold ``wanted`` entries.
    """
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_first].tolist(), second[by_second].tolist()
    by_first, by_second = by_first.tolist(), by_second.tolist()
    counts = held.tolist()
    masks: dict[int, int] = {}
    heap = [(a[0] + b[0], 0, 0)]
    found = 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        cell_first, cell_second = by_first[i], by_second[j]
        here = counts[cell_first][cell_second]
        if here:
            found += here
            masks[cell_first] = masks.get(cell_first, 0) | 1 << cell_second
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return masks


def _assigned(batches: Iterator[pa.RecordBatch], one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
    half = one.shape[1]
    for batch in batches:
        if batch.num_rows:
            rows = toplists.matrix(batch.column(1))
            cells = [pa.array(nearest(part, c).astype(np.int32)) for part, c in ((rows[:, :half], one), (rows[:, half:], two))]
            yield pa.record_batch([batch.column(0), batch.column(1), *cells, batch.column(2)], ["id", "vec", "one", "two", "row"])


def _asking(
    batches: Iterator[pa.RecordBatch], one: np.ndarray, two: np.ndarray, held: np.ndarray, wanted: int
) -> Iterator[pa.RecordBatch]:
    """A row per query and visited centroid of the first half, with the mask of the second half's."""
    half = one.shape[1]
    for batch in batches:
        rows = toplists.matrix(batch.column(1)) if batch.num_rows else np.zeros((0, half * 2))
        at, cells, masks = [], [], []
        for i, row in enumerate(rows):
            for cell, mask in visited(-(one @ row[:half]), -(two @ row[half:]), held, wanted).items():
                at.append(i)
                cells.append(cell)
                masks.append(mask if mask < 1 << 63 else mask - (1 << 64))
        taken = batch.take(pa.array(at, pa.int32()))
        yield pa.record_batch(
            [taken.column(0), taken.column(1), pa.array(cells, pa.int32()), pa.array(masks, pa.int64())],
            ["query_id", "query_vec", "one", "mask"],
        )


def _reranked(key, entries: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Inner products of the queries at one block with its entries in visited cells, the best ``k`` of each."""
    empty = pa.schema(
        [("query_id", pa.int64()), ("part", pa.int32()), ("top", pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64())])))]
    ).empty_table()
    if not entries.num_rows or not asked.num_rows:
        return empty
    entries = entries.sort_by("id")
    ids, query_ids = entries["id"].to_numpy(), asked["query_id"].to_numpy()
    query_vecs, vecs = toplists.matrix(asked["query_vec"]), toplists.matrix(entries["vec"])
    scores = query_vecs @ vecs.T
    masks = asked["mask"].to_numpy().astype(np.int64).view(np.uint64)
    seen = (masks[:, None] >> entries["two"].to_numpy().astype(np.uint64)[None, :]) & np.uint64(1) != 0
    seen &= query_ids[:, None] != entries["row"].to_numpy()[None, :]
    scores[~seen] = -np.inf
    # A matrix product may give equal rows scores that differ in the last digits: near ones stay and are scored alike.
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        picked = seen & (scores >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None])
    else:
        picked = seen
    at, column = np.nonzero(picked)
    scores[at, column] = np.einsum("ij,ij->i", query_vecs[at], vecs[column])
    some = picked.any(axis=1)
    part = np.full(int(some.sum()), entries["part"][0].as_py(), np.int32)
    return pa.table(
        {
            "query_id": pa.array(query_ids[some], pa.int64()),
            "part": pa.array(part),
            "top": toplists.lists(picked[some], scores[some], ids, pa.float64()),
        }
    )


def nearest_neighbours(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    queries: Column | None = None,
    k: int = TOP,
    centroids: int = CENTROIDS,
    share: float = SHARE,
    candidates: int = CANDIDATES,
    sample_rows: int = SAMPLE_ROWS,
    cell_rows: int = CELL_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """About the ``k`` largest inner products of every query with other rows: ``(query_id, rank, vec_id, score)``.

    Both halves of the vectors are quantised on their own, with centroids fitted on about ``sample_rows`` rows; every
    row is indexed under its pair of centroids. A query takes cells by the summed distance (the negated inner product)
    of the pair until they hold ``candidates`` entries and ``share`` of all, and all of those are scored in double
    precision on the original vectors. Cells are scored in blocks of bounded rows. Ties go to the smaller id.

    Queries are the rows that ``queries`` (a condition on ``id``) holds for, by default ids divisible by 20. Null ids,
    null, empty or zero vectors, and vectors with null or non-finite components take no part; vectors of another length
    than the commonest neither. Rows that repeat an id are rows of their own, as queries too. No rows give no rows; other
    columns are ignored. Jobs run while the result is planned.
    """
    if not 1 <= centroids <= 64:
        raise ValueError("centroids is between 1 and 64")
    queries = F.col("id") % 20 == 0 if queries is None else queries
    vectors = write_stage(toplists.usable(df, id_column, vector_column, zero=False), "vectors").df
    dim, rows = toplists.widest_group(vectors)
    vectors = vectors.where(F.size("vec") == dim)
    spark = df.sparkSession
    if not rows:
        return toplists.ranked(spark.createDataFrame([], "query_id bigint, top array<struct<neg: double, id: bigint>>"), vectors)
    drawn = min(1.0, sample_rows / rows)
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) <= int(drawn * (1 << 30)))
    fitted = toplists.matrix(sample.select("vec").toArrow()["vec"]) if sample.head() else np.zeros((0, dim))
    if not len(fitted):
        fitted = toplists.matrix(vectors.limit(sample_rows).select("vec").toArrow()["vec"])
    half = (dim + 1) // 2
    one = fit_centres(fitted[:, :half], centroids)
    two = fit_centres(fitted[:, half:], centroids) if dim > half else np.zeros((1, 0))

    placed = vectors.select("id", "vec", "row").mapInArrow(
        lambda batches: _assigned(batches, one, two), "id bigint, vec array<double>, one int, two int, row bigint"
    )
    placed = write_stage(placed, "cells").df
    held = np.zeros((len(one), len(two)), np.int64)
    for cell in placed.groupBy("one", "two").count().collect():  # at most 64 x 64 rows
        held[cell["one"], cell["two"]] = cell["count"]
    wanted = max(candidates, math.ceil(share * rows))

    asked = vectors.where(queries)
    asking = asked.select("row", "vec").mapInArrow(
        lambda batches: _asking(batches, one, two, held, wanted),
        "query_id bigint, query_vec array<double>, one int, mask bigint",
    )
    parts = np.maximum(1, -(-held.sum(axis=1) // cell_rows))
    starts = np.concatenate([[0], np.cumsum(parts)])
    blocks = max(1, math.ceil(asked.count() / query_rows))
    block_counts = F.array(*[F.lit(int(n)) for n in parts])
    first_parts = F.array(*[F.lit(int(n)) for n in starts[:-1]])
    n_parts = F.element_at(block_counts, F.col("one") + 1)
    first_part = F.element_at(first_parts, F.col("one") + 1)
    entries = placed.select(
        "id",
        "row",
        "vec",
        "two",
        (first_part + F.pmod(F.xxhash64("row"), n_parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("asked"),
    )
    spread = asking.select(
        "query_id",
        "query_vec",
        "mask",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("asked"),
        F.explode(F.sequence(first_part, first_part + n_parts - 1)).alias("part"),
    )
    tops = (
        entries.groupBy("part", "asked")
        .cogroup(spread.groupBy("part", "asked"))
        .applyInArrow(lambda key, left, right: _reranked(key, left, right, k), _TOPS)
    )
    return toplists.ranked(toplists.merged(tops, int(starts[-1]), k), asked)
