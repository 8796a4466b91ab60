"""A count-min sketch of 64-bit keys: partial sketches per task, merged in parts, looked up in tasks.

Beyond the keys that a sketch of bounded size tells apart, those it lets through are counted exactly in tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.words import mix, slices
from corpuskit.session import write_stage

ROWS = 2
PART_CELLS = 1 << 16
# Cells per row; the merged bits that are broadcast take a quarter byte per cell and row, 64 MB at most.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27
CELLS_PER_KEY = 4
# Keys a task gathers before it hands on a partial sketch.
_GATHERED = 1 << 19
_PARTIAL = "part int, cells binary, counts binary"
_MERGED = "part int, repeated binary, hot binary"


def cells_for(keys: float) -> int:
    """Cells of a row for about so many keys: a power of two within the bounds."""
    wanted = 1 << max(0, math.ceil(math.log2(max(1.0, keys * CELLS_PER_KEY))))
    return min(MOST_CELLS, max(LEAST_CELLS, wanted))


def _cells(keys: np.ndarray, cells: int, row: int) -> np.ndarray:
    spread = mix(keys ^ np.uint64(0x5851F42D4C957F2D * (row + 1) & (2**64 - 1)))
    return (spread & np.uint64(cells - 1)).astype(np.int64)


def _partial(keys: np.ndarray, cells: int) -> pa.RecordBatch:
    parts, at, counts = [], [], []
    for row in range(ROWS):
        held, n = np.unique(_cells(keys, cells, row), return_counts=True)
        part = held // PART_CELLS
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(held)]):
            parts.append(int(part[begin]) + row * (cells // PART_CELLS))
            at.append((held[begin:end] % PART_CELLS).astype("<u2").tobytes())
            counts.append(np.minimum(n[begin:end], 255).astype(np.uint8).tobytes())
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["part", "cells", "counts"])


def _merge(group: pa.Table, hot: int | None) -> pa.Table:
    total = np.zeros(PART_CELLS, np.int64)
    for cells, counts in zip(group["cells"], group["counts"]):
        np.add.at(total, np.frombuffer(cells.as_buffer(), "<u2"), np.frombuffer(counts.as_buffer(), np.uint8))
    repeated = np.packbits(total >= 2).tobytes()
    often = np.packbits(total >= hot).tobytes() if hot else b""
    return pa.table({"part": group["part"].slice(0, 1), "repeated": [repeated], "hot": [often]})


@dataclass(frozen=True)
class Estimates:
    """Which keys were counted twice or more, and which ``hot`` times or more; never too few, sometimes too many."""

    cells: int
    repeated: np.ndarray
    hot: np.ndarray | None

    def _all(self, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for row in range(ROWS):
            at = _cells(keys, self.cells, row)
            found &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
        return found

    def is_repeated(self, keys: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        return self._all(self.repeated, keys)

    def is_hot(self, keys: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        return self._all(self.hot, keys)


@dataclass(frozen=True)
class Listed:
    """The same for the rows of one batch, by the lists of exactly counted keys that they carry."""

    repeated: np.ndarray
    hot: np.ndarray

    @staticmethod
    def _marks(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return mix(keys ^ mix(owner.astype(np.uint64)))

    @classmethod
    def of(cls, part: pa.RecordBatch) -> Listed:
        sides = []
        for name in ("open", "often"):
            lists = part.column(part.schema.get_field_index(name))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sides.append(cls._marks(np.repeat(np.arange(len(lists)), sizes), keys))
        return cls(*sides)

    def is_repeated(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.isin(self._marks(owner, keys), self.repeated)

    def is_hot(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.isin(self._marks(owner, keys), self.hot)


def counted_in(counted: Estimates | None, part: pa.RecordBatch) -> Estimates | Listed:
    """What is known of the keys of a part of the rows that ``prefilter`` gave."""
    return Listed.of(part) if counted is None else counted


KeysOf = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def estimates(df: DataFrame, keys_of: KeysOf, cells: int, hot: int | None = None) -> Estimates:
    """Count the keys that ``keys_of`` gives, with the rows they are from, for parts of the batches of ``df (text)``.

    Every task sends the filled cells of its partial sketch, a count of 255 or more in one task as 255. The merged
    sketch reaches the driver as one bit per cell, two with ``hot``.
    """
    if hot is not None and not 2 <= hot <= 255:
        raise ValueError("hot is between 2 and 255")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in (x for batch in batches for x in slices(batch)):
            keys = keys_of(part)[1]
            held.append(keys)
            n += len(keys)
            if n >= _GATHERED:
                yield _partial(np.concatenate(held), cells)
                held, n = [], 0
        if n:
            yield _partial(np.concatenate(held), cells)

    merged = df.mapInArrow(partial, _PARTIAL).groupBy("part").applyInArrow(lambda group: _merge(group, hot), _MERGED)
    repeated = np.zeros((ROWS, cells // 8), np.uint8)
    often = np.zeros((ROWS, cells // 8), np.uint8) if hot else None
    width = PART_CELLS // 8
    for row in merged.toLocalIterator():
        sketch_row, part = divmod(row["part"], cells // PART_CELLS)
        here = slice(part * width, (part + 1) * width)
        repeated[sketch_row, here] = np.frombuffer(row["repeated"], np.uint8)
        if hot:
            often[sketch_row, here] = np.frombuffer(row["hot"], np.uint8)
    return Estimates(cells, repeated, often)


def prefilter(rows: DataFrame, keys_of: KeysOf, expected: float, hot: int | None = None):
    """``(rows, counted)``: the rows for a second pass, and a broadcast for ``counted_in`` to tell their keys by.

    ``rows`` has ``doc, mark, text`` and about ``expected`` keys. As long as a sketch has cells for these, rows stay as
    they are. Beyond, it lets too many through: those keys are then counted exactly, in tables, and each row carries
    the lists of its keys that came twice or more (``open``) and ``hot`` times or more (``often``). Keys are counted
    where they are first combined, and a key of very many rows can be split when it is joined back.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(estimates(rows.select("text"), keys_of, cells_for(expected), hot))
    if expected * CELLS_PER_KEY <= MOST_CELLS:
        return rows, shared

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            owner, keys = keys_of(part)
            wanted = shared.value.is_repeated(keys)
            at = pa.array(owner[wanted])
            held = [part.column(part.schema.get_field_index(name)).take(at) for name in ("doc", "mark")]
            yield pa.record_batch([*held, pa.array(keys[wanted].view(np.int64))], ["doc", "mark", "key"])

    keys = write_stage(rows.mapInArrow(kept, "doc bigint, mark bigint, key bigint"), "keys").df
    counts = write_stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts").df
    often = F.when(F.col("n") >= hot, F.col("key")) if hot else F.lit(None).cast("bigint")
    found = keys.join(counts.hint("merge"), "key").groupBy("doc", "mark").agg(
        F.collect_set("key").alias("open"), F.collect_set(often).alias("often")
    )
    found = write_stage(found, "open").df
    joined = rows.join(found.hint("merge"), ["doc", "mark"], "left").select(*rows.columns, "open", "often")
    return joined, context.broadcast(None)
