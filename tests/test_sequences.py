import re

import duckdb
import models
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions import sequences
from corpuskit.operators import ranking, windows

LENGTHS = [0, 1, 2, 3, 4, 5, 6, 15, 16, 17, 31, 32, 511, 512, 513, 1014, 1015, 1016, 1018, 1019, 1020, 1526, 2033]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(n, [(i * 37 + n) % 11 for i in range(n)]) for n in LENGTHS]
    return spark.createDataFrame(data, "doc_id int, ids array<int>").cache()


def ids_of(n):
    return [(i * 37 + n) % 11 for i in range(n)]


@pytest.mark.parametrize("chunk,seam", [(512, 5), (1, 0), (2, 1), (5, 3), (16, 6), (16, 0)])
def test_segments(rows, chunk, seam):
    got = {}
    for r in windows.segment(rows, chunk, seam).orderBy("doc_id", "chunk_no").collect():
        assert r.chunk_no == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append(r.ids)
    assert got == {n: models.segments(ids_of(n), chunk, seam) for n in LENGTHS}


@pytest.mark.parametrize("chunk,seam", [(512, 5), (16, 6), (2, 1)])
def test_segments_without_contained_windows(spark, chunk, seam):
    data = [(n, list(range(n))) for n in LENGTHS]
    df = spark.createDataFrame(data, "doc_id int, ids array<int>")
    got = {}
    for r in windows.segment(df, chunk, seam, dedup_tail=True).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    for n in LENGTHS:
        full = models.segments(list(range(n)), chunk, seam)
        assert got[n] == [w for w in full[:-1] if not set(w) <= set(full[-1])] + [full[-1]]
        assert sorted(set().union(*map(set, got[n]))) == list(range(n))


def test_segment_limits():
    with pytest.raises(ValueError):
        sequences.segments(F.col("ids"), 5, 5)
    with pytest.raises(ValueError):
        sequences.tail(F.col("ids"), 0)


@pytest.mark.parametrize("length", [1, 5, 512])
def test_tail(rows, length):
    got = {r.doc_id: r.ids for r in windows.tail(rows, length).collect()}
    assert got == {n: ids_of(n)[-length:] for n in LENGTHS}


def test_adjacent_pairs(rows):
    got = {}
    for r in windows.adjacent_pairs(rows).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.a, r.b))
    assert got == {n: models.adjacent(ids_of(n)) for n in LENGTHS if n >= 2}


@pytest.mark.parametrize("offsets", [(-1, 1), (-2, -1, 1, 2)])
def test_context_windows(rows, offsets):
    got = {}
    for r in windows.context_windows(rows, offsets).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.context, r.target))
    assert got == {n: models.contexts(ids_of(n), offsets, 2) for n in LENGTHS if n >= 5}


def test_causal_examples(rows):
    for r in windows.causal_examples(rows, ignore_id=4).collect():
        ids = ids_of(r.doc_id)
        assert (r.input_ids, r.label_ids) == (ids[:-1], ids[1:])
        assert r.n_labels == sum(x != 4 for x in ids[1:])


def test_templates_truncation_padding(rows):
    ids = sequences.pad(sequences.single_template(sequences.truncate(F.col("ids"), 16)), 16, 4)
    for r in rows.select("doc_id", ids.alias("ids")).collect():
        want = [1] + ids_of(r.doc_id)[:14] + [3]
        assert r.ids == want + [4] * (16 - len(want))


def test_pair_template(spark):
    df = spark.createDataFrame([([7, 8], [9]), ([], [])], "a array<int>, b array<int>")
    got = df.select(sequences.pair_template(F.col("a"), F.col("b")).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [([1, 7, 8, 2, 9, 3], [0, 0, 0, 0, 1, 0]), ([1, 2, 3], [0, 0, 0])]
    old = df.select(sequences.pair_template(F.col("a"), F.col("b"), end_id=2, end_type=1).alias("p")).first()
    assert tuple(old.p) == ([1, 7, 8, 2, 9, 2], [0, 0, 0, 0, 1, 1])


@pytest.mark.parametrize("batch", [1, 2, 5, 1000])
def test_row_pairs(rows, batch):
    got = sorted((r.doc_id, r.ids, r.next_ids) for r in windows.row_pairs(rows.repartition(3), ["doc_id"], batch=batch).collect())
    want = []
    for start in range(0, len(LENGTHS), batch):
        part = LENGTHS[start : start + batch]
        want += [(n, ids_of(n), ids_of(m)) for n, m in zip(part, part[1:])]
    assert got == sorted(want)


def test_length_stats(rows):
    row = windows.length_stats(rows).first()
    assert (row.n_rows, row.min_len, row.max_len) == (len(LENGTHS), 0, max(LENGTHS))
    assert row.mean_len_int == int(sum(LENGTHS) / len(LENGTHS))


def test_quantiles_without_sorting_equal_sorted_ones(spark):
    rng = np.random.default_rng(8)
    asked = [0.0, 0.001, 0.25, 0.5, 0.7, 0.99, 1.0]
    for values in ([5], [0, 2**31 - 1], [7] * 900 + rng.integers(0, 9, 300).tolist(), rng.integers(0, 2**31, 3000).tolist()):
        df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v bigint")
        numbers = df.toArrow()  # read by name below
        want = duckdb.sql(f"select quantile_disc(v, {asked}::double[]) from numbers").fetchall()[0][0]
        assert ranking.exact_quantiles(df, F.col("v"), asked) == want
    assert ranking.exact_quantiles(df.limit(0), F.col("v"), asked) == [None] * 7
    with pytest.raises(ValueError):
        ranking.exact_quantiles(spark.createDataFrame([(-1,)], "v int"), F.col("v"), [0.5])
    rows = spark.createDataFrame([([1] * n,) for n in (3, 0, 9)] + [(None,)], "ids array<int>")
    assert [r.length for r in windows.length_quantiles(rows, (0.0, 0.5, 1.0)).collect()] == [0, 3, 9]


def test_quantiles_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def counted(ids):
        seen.add(1)
        return ids

    rows = spark.createDataFrame([([1] * (n % 7),) for n in range(40)], "ids array<int>")
    rows = rows.withColumn("ids", counted.asNondeterministic()("ids"))
    assert [r.length for r in windows.length_quantiles(rows, (0.0, 0.5, 1.0)).collect()] == [0, 3, 6]
    assert seen.value == 40


def test_neighbours_are_read_by_compiled_expressions(rows):
    for df in (windows.adjacent_pairs(rows), windows.context_windows(rows, (-2, -1, 1, 2))):
        query = df._jdf.queryExecution()
        assert "lambdafunction" not in query.optimizedPlan().toString()
        # Only the key goes along with the exploded rows, not the list.
        assert re.search(r"Generate posexplode\(.*\), \[doc_id#\d+\],", query.executedPlan().toString())
    with pytest.raises(ValueError):
        windows.context_windows(rows, (-3, 3), margin=2)
    nulls = rows.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert windows.adjacent_pairs(nulls).count() == windows.context_windows(nulls).count() == 0
