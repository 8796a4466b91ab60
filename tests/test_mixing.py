import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import mixing, ranking, splitting


def key(seed, *parts):
    return hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()


def test_concat_keeps_copies(spark):
    df = spark.range(3)
    assert mixing.concat([df, df, df]).count() == 9


def test_mixture_weights(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    mixed = mixing.mixture(df, {"a": 2, "b": 0, "c": 1.25})
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts["a"] == 2000 and "b" not in counts
    assert 1150 < counts["c"] < 1350
    assert mixed.select("doc_id", "copy_no").distinct().count() == mixed.count()
    assert mixed.exceptAll(mixing.mixture(df.repartition(7), {"a": 2, "b": 0, "c": 1.25})).count() == 0


def test_shuffle_and_positions_agree(spark):
    df = spark.range(500)
    order = sorted(range(500), key=lambda i: key(9, i))
    assert [r.id for r in mixing.shuffle(df.repartition(5), ["id"], 9).collect()] == order
    placed = mixing.shuffled_position(df.repartition(3), ["id"], 9)
    assert [r.id for r in placed.orderBy("position").collect()] == order
    assert [r.position for r in placed.orderBy("position").collect()] == list(range(1, 501))


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500])
def test_sample_n_is_exact(spark, n):
    got = {r.id for r in mixing.sample_n(spark.range(500).repartition(6), n, ["id"]).collect()}
    assert got == set(sorted(range(500), key=lambda i: key(42, i))[:n])


def test_cut_through_copies_is_refused(spark):
    copies = spark.range(10).crossJoin(spark.range(4).withColumnRenamed("id", "copy"))
    with pytest.raises(ValueError):
        mixing.sample_n(copies, 6, ["id"])
    assert mixing.sample_n(copies, 8, ["id"]).count() == 8
    assert mixing.sample_n(copies, 6, ["id", "copy"]).count() == 6


def test_sample_n_needs_enough_rows(spark):
    with pytest.raises(ValueError):
        mixing.sample_n(spark.range(5), 6, ["id"])
    assert mixing.sample_batch(spark.range(5), ["id"], 6).count() == 5
    assert mixing.sample_batch(spark.range(0), ["id"], 6).count() == 0


@pytest.mark.parametrize("rows,share", [(1, 0.1), (9, 0.1), (10, 0.1), (11, 0.1), (1000, 0.1), (777, 0.33), (50, 0.0), (50, 1.0)])
def test_exact_split_size(spark, rows, share):
    labelled = splitting.split_exact(spark.range(rows).repartition(5), ["id"], share, 1)
    train, test = splitting.parts(labelled)
    wanted = set(sorted(range(rows), key=lambda i: key(1, i))[: math.ceil(share * rows)])
    assert {r.id for r in test.collect()} == wanted
    assert train.count() + len(wanted) == rows


def test_group_split_keeps_groups_together(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("g"), "id")
    sides = splitting.split_by_group(df, "g", 0.3).groupBy("g").agg(F.countDistinct("split").alias("n"))
    assert sides.where("n > 1").count() == 0


def test_global_rank_in_any_layout(spark):
    values = [(i * 7919 % 1000, f"w{i % 13}") for i in range(1000)]
    df = spark.createDataFrame(values, "a int, b string")
    want = {v: i + 1 for i, v in enumerate(sorted(values, key=lambda v: (v[1], -v[0])))}
    for parts in (1, 7):
        ranked = ranking.global_rank(df.repartition(parts), [F.asc("b"), F.desc("a")]).collect()
        assert {(r.a, r.b): r["rank"] for r in ranked} == want


def test_keys_with_separators_and_nulls_differ(spark):
    from corpuskit.functions.text import permutation_key

    rows = [("a:b", "c"), ("a", "b:c"), (None, "x"), ("x", None), ("\\N", "x"), ("a\\", "b:c")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(permutation_key(1, F.col("a"), F.col("b")).alias("h")).distinct().count() == len(rows)
