"""Hard negatives by integer inner product, with scores bounded along a spanning tree of the anchors.

Anchors meet shards of rows in tiles. Within a tile the anchors of a block form a minimum spanning tree. The root's scores
are computed; those of a child lie within its distance to the parent, times the row's norm, of the parent's. Only rows
whose bounds reach into what an anchor looks for are scored again, and the bounds below it start from those scores. What
an anchor looks for are first its best rows of its own label, then the rows of other labels in a window below each of
these.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import toplists
from corpuskit.operators.joins import lookup_join
from corpuskit.session import write_stage

SCALE = 256
POSITIVES = NEGATIVES = 5
# A negative scores at least so many hundredths of the positive.
LEAST_PERCENT = 80
SHARD_ROWS = 1024
ANCHOR_ROWS = 256

_PACKED = "grp bigint, block int, others int, ids binary, labels binary, vecs binary, vec_bytes int, starts binary, wanted binary"
_TOPS = "query_id bigint, part int, top array<struct<neg: bigint, id: bigint, row: bigint>>"
_HITS = pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64()), ("row", pa.int64())]))
_NO_TOPS = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("top", _HITS)]).empty_table()
_EXACT = float(1 << 53)


def spanning_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, length)`` of a minimum spanning tree from row 0: rows in the order they join, edges to parents."""
    n = len(rows)
    squares = (rows**2).sum(axis=1)
    distance = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * rows @ rows.T, 0))
    order, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
    nearest, outside = distance[0].copy(), np.ones(n, bool)
    outside[0] = False
    for step in range(1, n):
        new = int(np.where(outside, nearest, np.inf).argmin())
        order[step], outside[new] = new, False
        closer = outside & (distance[new] < nearest)
        parent[closer], nearest[closer] = new, distance[new][closer]
    # The products above are rounded; the edges that count are measured.
    return order, parent, np.sqrt(((rows - rows[parent]) ** 2).sum(axis=1))


def bounded(
    anchors: np.ndarray, rows: np.ndarray, open_rows: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, rows that were scored, their scores)`` for every anchor.

    ``open_rows(anchor, low, high)`` marks the rows that matter given bounds of their scores. Vectors hold integers as
    doubles, with products below 2^53.
    """
    norms = np.sqrt((rows**2).sum(axis=1))
    order, parent, length = spanning_tree(anchors)
    lows, highs = {}, {}
    left = np.bincount(parent[order[1:]], minlength=len(anchors))
    for step, anchor in enumerate(order.tolist()):
        if step == 0:
            low = high = rows @ anchors[anchor]
            at = np.flatnonzero(open_rows(anchor, low, high))
            scores = low[at]
        else:
            up = int(parent[anchor])
            reach = norms * (length[anchor] * (1 + 1e-9)) + 1
            low, high = lows[up] - reach, highs[up] + reach
            left[up] -= 1
            if not left[up]:
                del lows[up], highs[up]
            at = np.flatnonzero(open_rows(anchor, low, high))
            scores = rows[at] @ anchors[anchor]
            low[at] = high[at] = scores
        if left[anchor]:
            lows[anchor], highs[anchor] = low, high
        yield anchor, at, scores


def _scored(anchors: np.ndarray, rows: np.ndarray, open_rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``bounded``, with integer scores; where products may pass 2^53 all rows are scored in whole integers."""
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if anchors.shape[1] * largest < _EXACT:
        for anchor, at, scores in bounded(anchors, rows, open_rows):
            yield anchor, at, scores.astype(np.int64)
        return
    scores = toplists.products(anchors, rows)
    for anchor in range(len(anchors)):
        every = scores[anchor].astype(np.float64)
        # Rounding to double moves a score by less than one part in 2^52.
        reach = np.abs(every) * 2.0**-52
        at = np.flatnonzero(open_rows(anchor, every - reach, every + reach))
        yield anchor, at, scores[anchor, at]


def _threshold(lower: np.ndarray, k: int) -> float:
    """The ``k``-th largest of the lower bounds: fewer than ``k`` rows with less cannot be among the best."""
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf


def _first(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """Rows of the ``k`` largest scores, of equal ones those of smaller id."""
    if len(at) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        at, scores = at[keep], scores[keep]
    order = np.lexsort((rows[at], ids[at], -scores))[:k]
    return at[order], scores[order]


class Tile:
    """A block of anchors and a shard of rows."""

    def __init__(self, shard: dict, block: dict):
        self.ids, self.rows = np.frombuffer(shard["ids"], "<i8").reshape(2, -1)
        self.labels = np.frombuffer(shard["labels"], "<i8")
        self.vecs = unpacked(shard)
        self.anchor_rows = np.frombuffer(block["ids"], "<i8").reshape(2, -1)[1]
        self.anchor_labels = np.frombuffer(block["labels"], "<i8")
        self.anchors = unpacked(block)
        starts = np.frombuffer(block["starts"], "<i4").tolist()
        wanted = np.frombuffer(block["wanted"], "<i8").tolist()
        self.wanted = [wanted[a:b] for a, b in zip(starts, starts[1:])]

    def positives(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(anchor's row, rows, scores)``: the best ``k`` of the anchor's label but itself."""

        def of_label(anchor: int) -> np.ndarray:
            return (self.labels == self.anchor_labels[anchor]) & (self.rows != self.anchor_rows[anchor])

        def open_rows(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            fit = of_label(anchor)
            return fit & (high >= _threshold(low[fit], k))

        for anchor, at, scores in _scored(self.anchors, self.vecs, open_rows):
            yield int(self.anchor_rows[anchor]), *_first(at, scores, self.ids, self.rows, k)

    def negatives(self, k: int, percent: int, slots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(key, rows, scores)`` for every window: the best ``k`` of other labels in it.

        The key is the anchor's row times ``slots`` and the number of the positive.
        """

        def window(positive: int) -> tuple[int, int]:
            return -(-percent * positive // 100), positive

        def open_rows(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            other = self.labels != self.anchor_labels[anchor]
            found = np.zeros(len(low), bool)
            for least, most in {window(p) for p in self.wanted[anchor]}:
                if least <= most:
                    least, most = np.nextafter(float(least), -np.inf), np.nextafter(float(most), np.inf)
                    inside = other & (high >= least) & (low <= most)
                    sure = inside & (low >= least + 2) & (high <= most - 2)
                    found |= inside & (high >= _threshold(low[sure], k))
            return found

        for anchor, at, scores in _scored(self.anchors, self.vecs, open_rows):
            other = self.labels[at] != self.anchor_labels[anchor]
            for slot, positive in enumerate(self.wanted[anchor]):
                least, most = window(positive)
                keep = other & (scores >= least) & (scores <= most)
                if keep.any():
                    key = int(self.anchor_rows[anchor]) * slots + slot
                    yield key, *_first(at[keep], scores[keep], self.ids, self.rows, k)


def unpacked(block: dict) -> np.ndarray:
    size = len(block["ids"]) // 16
    return np.frombuffer(block["vecs"], f"<{'i' if block['vec_bytes'] == 4 else 'f'}{block['vec_bytes']}").reshape(size, -1).astype(np.float64)


def _pack(group: pa.Table) -> pa.Table:
    """One row of a block: ids, row numbers, labels, vectors in 4 bytes a number where they fit, scores of positives."""
    vecs = toplists.matrix(group["q"])
    narrow = float(np.abs(vecs).max(initial=0)) < 2**31
    wanted = group["wanted"].to_pylist()
    starts = np.cumsum([0, *map(len, wanted)]).astype("<i4")
    ids = np.stack([group["id"].to_numpy(), group["row"].to_numpy()]).astype("<i8")
    return pa.table(
        {
            "grp": pa.array([group["grp"][0].as_py()], pa.int64()),
            "block": pa.array([group["block"][0].as_py()], pa.int32()),
            "others": pa.array([group["others"][0].as_py()], pa.int32()),
            "ids": [ids.tobytes()],
            "labels": [group["label"].to_numpy().astype("<i8").tobytes()],
            "vecs": [vecs.astype("<i4" if narrow else "<f8").tobytes()],
            "vec_bytes": pa.array([4 if narrow else 8], pa.int32()),
            "starts": [starts.tobytes()],
            "wanted": [np.array([p for one in wanted for p in one], "<i8").tobytes()],
        }
    )


def _packed(rows: DataFrame, count: Column, others: Column, label: str) -> DataFrame:
    """Rows of every group ``grp`` dealt evenly over ``count`` blocks, each packed to one row.

    ``others`` is how many blocks of the other side the group has.
    """
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), count).cast("int")).withColumn("others", others.cast("int"))
    columns = ["grp", "block", "others", "id", "row", "label", "q", "wanted"]
    return write_stage(dealt.select(*columns).groupBy("grp", "block").applyInArrow(_pack, _PACKED), label).df


def _tiles(shards: DataFrame, blocks: DataFrame, sides: tuple[int, int], count: int, k: int, kind: str, *args) -> DataFrame:
    """Every block with every shard of its group, as lists ``(query_id, part, top)`` of the best ``k`` of a tile.

    A tile holds so many shards and blocks as ``sides`` says; there are about ``count``. Both carry the number of blocks of
    the other side, so that a tile is one key of the shuffle.
    """
    shard_side, block_side = sides
    columns = ["ids", "labels", "vecs", "vec_bytes", "starts", "wanted"]

    def dealt(rows: DataFrame, own: str, own_side: int, other: str, other_side: int) -> DataFrame:
        others = F.sequence(F.lit(0), F.floor((F.col("others") - 1) / other_side).cast("int"))
        return rows.select("grp", F.floor(F.col("block") / own_side).cast("int").alias(own), F.explode(others).alias(other), *columns)

    def scan(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return _NO_TOPS
        part = held["part"][0].as_py()
        held = held.select(columns).to_pylist()
        return pa.concat_tables(_tops(held, block, part, k, kind, args) for block in asked.select(columns).to_pylist())

    left = dealt(shards, "part", shard_side, "call", block_side)
    right = dealt(blocks, "call", block_side, "part", shard_side)
    return toplists.tiles(left, right, ["grp", "part", "call"], count, scan, _TOPS)


def _tops(shards: list[dict], block: dict, part: int, k: int, kind: str, args) -> pa.Table:
    """The best ``k`` of all shards for every key of a block."""
    found = [[np.empty(0, np.int64)] * 4]
    for shard in shards:
        tile = Tile(shard, block)
        for key, at, scores in getattr(tile, kind)(*args):
            found.append([np.full(len(at), key), -scores, tile.ids[at], tile.rows[at]])
    keys, *hits = (np.concatenate(x) for x in zip(*found))
    first = toplists.first_of(keys, k, *hits)
    keys, size = np.unique(keys[first], return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    tops = pa.StructArray.from_arrays([pa.array(x[first], pa.int64()) for x in hits], ["neg", "id", "row"])
    return pa.table(
        [pa.array(keys, pa.int64()), pa.array(np.full(len(keys), part, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), tops)],
        schema=_NO_TOPS.schema,
    )


def _tile_count(shards: int, blocks: int, sides: tuple[int, int]) -> int:
    return math.ceil(shards / sides[0]) * math.ceil(blocks / sides[1])


def _blocks(n: Column, rows: int) -> Column:
    return F.ceil(n / rows).cast("int")


def usable_rows(df: DataFrame, scale: int) -> DataFrame:
    """``(id, row, label, q)`` of the rows that take part, with a number of their own; see ``hard_negatives``."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), vec.alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~bad)
    # floor() of Spark ends at 2^63; doubles beyond 2^53 are whole numbers.
    whole = F.transform("vec", lambda x: F.when(F.abs(x * scale) < _EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.select("id", F.monotonically_increasing_id().alias("row"), "label", whole.alias("q"))


def hard_negatives(
    df: DataFrame,
    anchors: Column | None = None,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
    shard_rows: int = SHARD_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vec_id, label, embedding``.

    A component ``x`` counts as ``floor(scale * x)`` and a row's score is its integer inner product with the anchor.
    Anchors are the rows that ``anchors`` (a condition on ``id``) holds for, by default ids divisible by 100. An anchor's
    positives are its ``positives`` best other rows of its label, its negatives for one of them the ``negatives`` best
    rows of other labels that score at least ``percent`` hundredths of the positive and no more than it. Equal scores are
    in order of id; scores beyond a long are cut to its bounds.

    Null ids and labels, null or empty vectors, and vectors with null or non-finite components take no part; vectors of
    another length than the commonest neither. Rows that repeat an id are rows of their own, as anchors too. No rows give
    no rows; other columns are ignored. Jobs run while the result is planned.
    """
    asked = F.col("id") % 100 == 0 if anchors is None else anchors
    rows = write_stage(usable_rows(df, scale), "vectors").df
    dim, _ = toplists.widest_group(rows.withColumnRenamed("q", "vec"))
    rows = rows.where(F.size("q") == dim).withColumn("wanted", F.array().cast("array<bigint>"))

    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("m"))
    sizes = write_stage(sizes, "sizes").df
    counts = sizes.select("label", _blocks(F.col("n"), shard_rows).alias("shards"), _blocks(F.col("m"), anchor_rows).alias("blocks"))
    with_anchors = F.when(F.col("blocks") > 0, F.col("shards"))
    # The widest label's shards and blocks, and all shards of labels with anchors.
    widest, most, every = counts.agg(F.max(with_anchors), F.max("blocks"), F.sum(with_anchors)).first()
    if not most:
        schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return df.sparkSession.createDataFrame([], schema)
    placed = lookup_join(rows, counts, ["label"]).where("blocks > 0").withColumn("grp", F.col("label"))
    placed = write_stage(placed, "placed").df

    shards = _packed(placed, F.col("shards"), F.col("blocks"), "shards")
    blocks = _packed(placed.where(asked), F.col("blocks"), F.col("shards"), "anchors")
    cores = df.sparkSession.sparkContext.defaultParallelism
    sides = toplists.tile_sides(every, most, shard_rows, anchor_rows, dim, cores)
    tops = _tiles(shards, blocks, sides, _tile_count(every, most, sides), positives, "positives", positives)
    best = toplists.merged(tops, math.ceil(widest / sides[0]), positives)
    best = write_stage(best.where(F.size("top") > 0), "positives").df

    n, m = rows.count(), best.count()
    all_shards, all_blocks = math.ceil(n / shard_rows), max(1, math.ceil(m / anchor_rows))
    scores = F.transform("top", lambda hit: -hit["neg"])
    seeking = placed.where(asked).drop("wanted").join(best.select(F.col("query_id").alias("row"), scores.alias("wanted")), "row")
    one = F.lit(0).cast("bigint")
    shards = _packed(rows.withColumn("grp", one), F.lit(all_shards), F.lit(all_blocks), "shards")
    blocks = _packed(seeking.withColumn("grp", one), F.lit(all_blocks), F.lit(all_shards), "anchors")
    sides = toplists.tile_sides(all_shards, all_blocks, shard_rows, anchor_rows, dim, cores)
    tops = _tiles(shards, blocks, sides, _tile_count(all_shards, all_blocks, sides), negatives, "negatives", negatives, percent, positives)
    found = toplists.merged(tops, math.ceil(all_shards / sides[0]), negatives)

    pairs = best.select(F.col("query_id").alias("row"), F.posexplode("top").alias("slot", "hit"))
    pairs = pairs.join(placed.where(asked).select("row", F.col("id").alias("anchor_id")), "row").select(
        (F.col("row") * positives + F.col("slot")).alias("query_id"),
        "anchor_id",
        F.col("hit.id").alias("positive_id"),
        (-F.col("hit.neg")).alias("positive_score"),
    )
    return pairs.join(found, "query_id").select(
        "anchor_id", "positive_id", F.posexplode("top").alias("rank", "hit"), "positive_score"
    ).select(
        "anchor_id",
        "positive_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("hit.id").alias("negative_id"),
        "positive_score",
        (-F.col("hit.neg")).alias("negative_score"),
    )


# The same as hard_negatives in DuckDB, for rows with distinct ids.
NEGATIVES_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE))::DOUBLE[] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""


def shifted_labels(df: DataFrame) -> DataFrame:
    """Rows whose ``vec_id`` is divisible by 7 with the next of ten labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return df.select("vec_id", label.alias("label"), "embedding")
