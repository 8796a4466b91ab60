import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.llm import neighbours, queries, topk, toplists

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vec string, part string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in vectors], SCHEMA)


def random_vectors(n, dim=16, seed=3):
    rows = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, [float(x) for x in row]) for i, row in enumerate(rows)]


def expected(vectors, score, k=20):
    out = []
    for at, (q, a) in enumerate(vectors):
        if q % 20 == 0:
            ranked = sorted((-score(a, b), i) for n, (i, b) in enumerate(vectors) if n != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


def integer_product(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))


ODD = [
    (None, [1.0, 0.0, 0.0]),
    (900, None),
    (901, [1.0, None, 0.0]),
    (902, [1.0, float("nan"), 0.0]),
    (903, [float("inf"), 0.0, 0.0]),
    (904, []),
    (905, [1.0, 2.0]),
]


def test_exact_matches_brute_force_with_ties_copies_and_odd_rows(spark):
    vectors = [(i, [round(x, 1) for x in v[:3]]) for i, v in random_vectors(90)]
    vectors += [(100 + i, [0.5, 0.5, 0.5]) for i in range(60)] + [(-20, [0.0, 0.0, 0.0])]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    vectors += vectors[:5]
    found = topk.exact_top_k(frame(spark, vectors + ODD), shard_rows=16, query_rows=3)
    assert [f.dataType.simpleString() for f in found.schema][:4] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(tuple(r) for r in found.collect()) == expected(vectors, integer_product)


def test_exact_with_few_rows_and_large_components(spark):
    vectors = [(0, [1e6, -1e6]), (1, [-1e6, 1e6]), (2, [3e7, 1e-9]), (3, [4e7, 5.0]), (4, [-3.0, 1e8])]
    vectors += [(20, [0.0, 0.25])]
    found = topk.exact_top_k(frame(spark, vectors))
    assert sorted(tuple(r) for r in found.collect()) == expected(
        [(i, [float(np.float32(x)) for x in v]) for i, v in vectors], integer_product
    )


@pytest.mark.parametrize("search", [topk.exact_top_k, neighbours.nearest_neighbours])
def test_no_rows(spark, search):
    found = search(frame(spark, []))
    assert found.count() == 0 and found.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    assert search(frame(spark, ODD[:4])).count() == 0


def test_index_reaches_its_recall_and_scores_exactly(spark):
    vectors = random_vectors(3000, dim=24)
    table = dict(vectors)
    found = neighbours.nearest_neighbours(frame(spark, vectors + ODD + [(906, [0.0] * 24)]), candidates=300).collect()
    best = expected(vectors, lambda a, b: float(np.dot(a, b)))
    hits = {(q, i) for q, _, i, _ in best} & {(r.query_id, r.vec_id) for r in found}
    assert len(found) == len(best) and len(hits) >= 0.9 * len(best)
    assert all(abs(r.score - np.dot(table[r.query_id], table[r.vec_id])) < 1e-9 for r in found)
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(rows == sorted(rows) for rows in by_query.values())


@pytest.mark.parametrize("dim", [3, 128])
def test_index_ties_and_repeated_ids(spark, dim):
    rows = random_vectors(120, dim=dim)
    copies = [(500 + i, rows[7][1]) for i in range(90)] + rows[:3] + [(40, rows[9][1])]
    found = neighbours.nearest_neighbours(frame(spark, rows + copies), share=1.0, cell_rows=16, query_rows=3)
    narrow = [(i, [float(np.float32(x)) for x in v]) for i, v in rows + copies]
    wanted = expected(narrow, lambda a, b: float(np.einsum("i,i->", np.array(a), np.array(b))))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == sorted(x[:3] for x in wanted)


def test_index_with_one_vector_in_a_third_of_all_rows(spark):
    vectors = random_vectors(400, dim=8) + [(1000 + i, [0.3] * 8) for i in range(200)]
    found = neighbours.nearest_neighbours(frame(spark, vectors), share=1.0, cell_rows=64, query_rows=8).collect()
    got = [(r.query_id, r.rank, r.vec_id) for r in sorted(found)]
    narrow = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    assert got == [x[:3] for x in expected(narrow, lambda a, b: float(np.dot(a, b)))]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=9, max_size=9), min_size=1, max_size=5), st.integers(1, 9))
def test_best_takes_leftmost_of_equals(rows, k):
    scores = np.array(rows)
    for row, mask in zip(rows, toplists.best(scores, k)):
        order = sorted(range(9), key=lambda i: (-row[i], i))[:k]
        assert set(np.flatnonzero(mask)) == set(order)


def test_heap_visits_pairs_in_order_of_distance():
    rng = np.random.default_rng(1)
    first, second, held = rng.normal(size=6), rng.normal(size=5), rng.integers(0, 9, (6, 5))
    pairs = sorted((first[i] + second[j], i, j) for i in range(6) for j in range(5))
    for wanted in (1, 20, 60, 10**6):
        taken, total = set(), 0
        for _, i, j in pairs:
            if total >= wanted:
                break
            total += held[i, j]
            if held[i, j]:
                taken.add((i, j))
        masks = neighbours.visited(first, second, held, wanted)
        assert {(i, j) for i, m in masks.items() for j in range(5) if m >> j & 1} == taken


def test_registered_query_equals_sql(spark):
    directory = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{directory}/embeddings.parquet'")
    mine = queries.QUERIES["op2_exact_top_k"](spark, directory)
    assert sorted(tuple(r) for r in mine.collect()) == sorted(con.sql(queries.ORACLE["op2_exact_top_k"]).fetchall())
