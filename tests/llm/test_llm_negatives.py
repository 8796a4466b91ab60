import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.llm import negatives, queries, toplists

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, row string, grp string, q string, top string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", "q", "t") for i, v, label in rows], SCHEMA)


def random_rows(n, dim=6, labels=3, seed=1, digits=None):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, dim)) if digits is None else rng.normal(size=(n, dim)).round(digits)
    return [(i, [float(np.float32(x)) for x in v], int(k)) for i, (v, k) in enumerate(zip(vecs, rng.integers(0, labels, n)))]


def expected(rows, step=100, scale=256, k=5):
    """Straight from the definition, in whole numbers."""
    usable = [
        (i, [math.floor(scale * x) for x in v], label)
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    dims = [len(v) for _, v, _ in usable]
    usable = [r for r in usable if len(r[1]) == max(sorted(set(dims)), key=dims.count)] if dims else []
    out = []
    for at, (anchor, a, label) in enumerate(usable):
        if anchor % step:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, v)), i, other == label) for n, (i, v, other) in enumerate(usable) if n != at
        )
        for neg, positive, _ in [s for s in scored if s[2]][:k]:
            inside = [s for s in scored if not s[2] and 80 * -neg <= 100 * -s[0] <= 100 * -neg][:k]
            out += [(anchor, positive, r + 1, i, -neg, -s) for r, (s, i, _) in enumerate(inside)]
    return sorted(out)


ODD = [
    (None, [1.0] * 6, 1),
    (900, None, 1),
    (901, [1.0] * 5 + [None], 1),
    (902, [float("nan")] + [1.0] * 5, 1),
    (903, [float("-inf")] + [1.0] * 5, 1),
    (904, [], 1),
    (905, [1.0, 2.0], 1),
    (800, [1.0] * 6, None),
]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_brute_force_over_many_tiles(spark):
    rows = random_rows(400)
    mine = negatives.hard_negatives(frame(spark, rows + ODD), shard_rows=37, anchor_rows=2)
    assert [f.dataType.simpleString() for f in mine.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert found(mine) == expected(rows + ODD)


def test_ties_copies_and_repeated_ids(spark):
    rows = random_rows(120, dim=2, labels=2, digits=0) + [(200 + i, [1.0, 1.0], i % 2) for i in range(60)]
    rows += rows[:3] + rows[:1] + [(100, [2.0, -1.0], 1), (-100, [0.0, 0.0], 0)]
    assert found(negatives.hard_negatives(frame(spark, rows), shard_rows=16, anchor_rows=3)) == expected(rows)


def test_one_label_in_most_rows_and_many_small_labels(spark):
    rows = [(i, v, 0 if i % 3 else i) for i, v, _ in random_rows(300)]
    asked = negatives.F.col("id") % 10 == 0
    assert found(negatives.hard_negatives(frame(spark, rows), anchors=asked, shard_rows=20, anchor_rows=4)) == expected(rows, 10)


@pytest.mark.parametrize("size", [1e5, 3e6, 1e7])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [float(np.float32(x * size)) for x in v], k) for i, v, k in random_rows(60, dim=2)]
    assert found(negatives.hard_negatives(frame(spark, rows), shard_rows=16)) == expected(rows)


def test_no_rows_and_no_anchors(spark):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in ([], ODD, [(1, [1.0], 0), (2, [1.0], 1)], [(100, [1.0], 0)]):
        mine = negatives.hard_negatives(frame(spark, rows))
        assert mine.columns == columns and mine.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6))
def test_bounds_hold_along_the_tree(n, seed):
    rng = np.random.default_rng(seed)
    anchors = np.floor(rng.normal(size=(n, 4)) * rng.choice([1, 1000])).round()
    rows = np.floor(rng.normal(size=(30, 4)) * 256)
    truth = anchors @ rows.T
    seen = []

    def open_rows(anchor, low, high):
        assert (low <= truth[anchor]).all() and (truth[anchor] <= high).all()
        return rng.random(30) < 0.3

    for anchor, at, scores in negatives.bounded(anchors, rows, open_rows):
        seen.append(anchor)
        assert (scores == truth[anchor][at]).all()
    assert sorted(seen) == list(range(n))


def test_tree_is_a_shortest_one():
    rows = np.random.default_rng(4).normal(size=(40, 3))
    order, parent, length = negatives.spanning_tree(rows)
    edges = sorted((np.linalg.norm(rows[i] - rows[j]), i, j) for i in range(40) for j in range(i))
    group, total = list(range(40)), 0.0
    for d, i, j in edges:
        if group[i] != group[j]:
            total += d
            group = [group[i] if g == group[j] else g for g in group]
    assert abs(length.sum() - total) < 1e-9 and sorted(order) == list(range(40))
    assert all(list(order).index(parent[i]) < list(order).index(i) for i in order[1:])


def test_clusters_leave_most_rows_unscored():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 2000
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(800, 16)))
    anchors = rows[::20]
    scored = 0
    for _, at, _ in negatives.bounded(anchors, rows, lambda a, low, high: high >= negatives._threshold(low, 5)):
        scored += len(at)
    assert scored < 0.3 * len(anchors) * len(rows)


def test_products_are_exact_at_every_size():
    rng = np.random.default_rng(6)
    for size in (3, 1e4, 1e7, 1e9, 1e18):
        a, b = (np.floor(rng.normal(size=(5, 7)) * size) for _ in range(2))
        whole = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
        cut = [[max(min(x, 2**63 - 1), -(2**63) + 1) for x in r] for r in whole]
        assert toplists.products(a, b).tolist() == cut


def test_registered_query_equals_sql(spark):
    directory = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{directory}/embeddings.parquet'")
    mine = queries.QUERIES["op12_tree_bound_negatives"](spark, directory)
    assert found(mine) == sorted(con.sql(queries.ORACLE["op12_tree_bound_negatives"]).fetchall())
