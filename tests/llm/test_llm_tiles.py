import numpy as np
import pytest

from corpuskit.llm import negatives, topk, toplists


def vectors(spark, n=600, dim=4):
    rows = np.random.default_rng(9).normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>, label int")


def handed(monkeypatch, run):
    """The lists that tiles hand on, as ``(lists, parts)``, and the plans behind them."""
    found, plans, merged = [], [], toplists.merged

    def seen(tops, parts, k):
        found.append((tops.count(), parts))
        plans.append(tops._jdf.queryExecution().executedPlan().toString())
        return merged(tops, parts, k)

    monkeypatch.setattr(toplists, "merged", seen)
    rows = sorted(tuple(r) for r in run().collect())
    monkeypatch.setattr(toplists, "merged", merged)
    return rows, found, plans


@pytest.mark.parametrize(
    "run",
    [
        lambda df: topk.exact_top_k(df, queries=topk.F.col("id") < 30, k=3, shard_rows=4, query_rows=8),
        lambda df: negatives.hard_negatives(df, anchors=topk.F.col("id") < 30, shard_rows=4, anchor_rows=8),
    ],
)
def test_tiles_of_many_blocks_hand_on_one_list_and_pass_no_driver(spark, monkeypatch, run):
    df, results = vectors(spark), {}
    for size in (1, toplists.TILE_BYTES):
        monkeypatch.setattr(toplists, "TILE_BYTES", size)
        rows, found, plans = handed(monkeypatch, lambda: run(df))
        results[size] = rows
        # A broadcast of repeated blocks goes through the driver, whatever the size of the tables.
        assert not any("Broadcast" in plan for plan in plans)
        assert all(lists <= 150 * parts for lists, parts in found)
    # Blocks of one shard each, then of several: 600 rows are 150 shards, 32 tiles are enough for 8 cores.
    assert max(parts for _, parts in found) < 75
    assert results[1] == results[toplists.TILE_BYTES] and results[1]


def test_first_of_every_key():
    keys, neg, ids = (np.array(x) for x in ([2, 1, 2, 2, 1], [5, 3, 4, 4, 3], [0, 9, 8, 7, 1]))
    assert toplists.first_of(keys, 2, neg, ids).tolist() == [4, 1, 3, 2]
    assert toplists.first_of(keys[:0], 2, neg[:0]).tolist() == []


def test_sides_fill_a_tile_and_leave_work_to_all_cores():
    assert toplists.tile_sides(6000, 1200, 1024, 256, 64, 6) == (64, 256)
    assert toplists.tile_sides(600, 121, 1024, 256, 64, 6) == (25, 121)
    assert toplists.tile_sides(1, 1, 1024, 256, 64, 6) == (1, 1)
    assert toplists.tile_sides(10, 100, 1024, 256, 10**6, 6) == (1, 1)
    assert toplists.tile_sides(2, 96, 1024, 256, 64, 6) == (1, 8)
