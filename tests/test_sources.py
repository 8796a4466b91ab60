import os

import pytest
from pyspark.sql import functions as F

from corpuskit.session import scratch_root, write_stage
from corpuskit.sources import cache, readers


def test_jsonl_skips_blank_lines_and_fails_on_broken_ones(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"system": "s", "input": "ü", "output": null}\n\n   \n{"input": "x", "extra": 1}\n', encoding="utf-8")
    schema = "system string, input string, output string"
    got = [tuple(r) for r in readers.read_jsonl(spark, str(good), schema).collect()]
    assert sorted(got, key=str) == sorted([("s", "ü", None), (None, "x", None)], key=str)
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"input": "x"}\n{"input": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(bad), schema).collect()


def test_source_spec_prunes_the_scan(spark, tmp_path):
    path = str(tmp_path / "src")
    spark.range(10).select("id", F.lit("u").alias("url"), F.lit("t").alias("text"), F.when(F.col("id") < 4, "train").otherwise("test").alias("split")).write.partitionBy("split").parquet(path)
    registry = readers.SourceRegistry([readers.SourceSpec("s", path, split="train", columns=("id", "text"), weight=2)])
    df = registry.read(spark, "s")
    assert df.columns == ["id", "text"] and df.count() == 4
    assert registry.weights() == {"s": 2}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan and "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError):
        registry.add(readers.SourceSpec("s", path))


def test_tables(spark, tmp_path):
    df = readers.from_rows(spark, [(2, "b"), (1, "a")], "id int, t string")
    readers.save_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        readers.save_table(df, str(tmp_path / "t"))
    loaded = readers.load_table(spark, str(tmp_path / "t"), keep_in_memory=True)
    assert loaded.is_cached and readers.n_rows(loaded) == 2
    assert readers.peek(loaded, ["id"]).first().t == "a"


def test_cache_hit_miss_and_interruption(spark, tmp_path):
    root, calls = str(tmp_path / "cache"), []

    def run(df, **params):
        def build():
            calls.append(params)
            return df.where("id % 2 = 0"), df.where("id % 2 = 1")

        return cache.materialize(spark, root, "halves", build, params, {"df": df})

    a, b = spark.range(10), spark.range(10, 20)
    even, odd = run(a, n=1)
    assert (even.count(), odd.count(), len(calls)) == (5, 5, 1)
    run(a.repartition(3), n=1)
    assert len(calls) == 1, "the same rows in another layout are the same input"
    run(a, n=2)
    assert len(calls) == 2, "other parameters"
    assert run(b, n=1)[0].first().id >= 10 and len(calls) == 3, "same shape, other contents"
    for name in os.listdir(root):
        marker = os.path.join(root, name, "manifest", "_SUCCESS")
        os.rename(marker, marker + ".gone")
    assert run(a, n=1)[1].count() == 5 and len(calls) == 4, "an unfinished write is no hit"


def test_single_result(spark, tmp_path):
    build = lambda: spark.range(3)
    assert cache.materialize(spark, str(tmp_path), "one", build, {}, {"v": "1"}).count() == 3


def test_fingerprint_sees_values_not_layout(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert cache.fingerprint(df) == cache.fingerprint(df.repartition(5).orderBy(F.desc("id")))
    assert cache.fingerprint(df) != cache.fingerprint(df.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x"))))
    assert cache.fingerprint(df) != cache.fingerprint(df.union(df.limit(1)))


def test_stage_lies_in_the_named_folder(spark):
    stage = write_stage(spark.range(5), "t")
    assert stage.path.startswith(scratch_root(spark)) and scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert stage.df.count() == 5
    stage.drop()
    assert not os.path.exists(stage.path)


def test_fingerprint_sees_where_nulls_are(spark, tmp_path):
    schema = "a string, b string"
    first, second = (spark.createDataFrame([r], schema) for r in ((None, "x"), ("x", None)))
    assert cache.fingerprint(first) != cache.fingerprint(second)
    first.write.parquet(str(tmp_path / "t"))
    before = cache.file_fingerprint(spark, str(tmp_path / "t"))
    assert before == cache.file_fingerprint(spark, str(tmp_path / "t"))
    second.write.mode("append").parquet(str(tmp_path / "t"))
    assert before != cache.file_fingerprint(spark, str(tmp_path / "t"))


def test_many_runs_share_a_loss_file(spark, tmp_path):
    rows = [("a", [1.5, None, float("nan")]), ("b", []), (None, [2.0])]
    spark.createDataFrame(rows, "run string, losses array<double>").coalesce(1).write.json(str(tmp_path / "log"))
    got = readers.load_loss_log(spark, str(tmp_path / "log"), lines=True).collect()
    assert sorted(((r.run or "", r.step, str(r.loss)) for r in got)) == [("", 0, "2.0"), ("a", 0, "1.5"), ("a", 1, "None"), ("a", 2, "nan")]
    from corpuskit.plans import catalog

    query = catalog.QUERIES["loss_log_read"](spark, "/root/testdata/sf0.01")
    assert query.select("run").distinct().count() > 100 and len(query.inputFiles()) <= 16
