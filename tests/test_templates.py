from pyspark.sql import functions as F

from corpuskit.operators import projection, templates


def test_fields_show_values_like_a_format_string(spark):
    answers = [
        ["plain", "it's", 'say "x"', "it's \"x\"", "a\\b", "l1\nl2\tt\rr", "wide　gap", "nb\xa0sp", "😁", "\x07", "​"],
        [],
        None,
        ["x", None],
    ]
    rows = [("q", True, 5, a) for a in answers] + [(None, None, None, ["z"])]
    df = spark.createDataFrame(rows, "question string, ok boolean, n int, answers array<string>")
    got = [r.text for r in templates.render_fields(df).collect()]
    names = df.columns
    assert got == ["".join(f"{k}\n{v}\nend\n" for k, v in zip(names, row)) for row in rows]


def test_pair_keeps_empty_sides(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert [r.text for r in templates.render_pair(df, "x", "y").collect()] == ["a\nb", "\nb", "a\n"]


def test_chat_forms_agree(spark):
    turns = [(1, 2, "Input", "q"), (1, 1, "I'm ok", None), (1, 3, "Output", "a\nb"), (2, 1, "user", "")]
    rows = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    want = {
        1: "[I'm ok]\nNone\n[SEP]\n[Input]\nq\n[SEP]\n[Output]\na\nb\n[SEP]\n",
        2: "[user]\n\n[SEP]\n",
    }
    assert {r.conv_id: r.text for r in templates.render_chat(rows.repartition(3)).collect()} == want
    nested = spark.createDataFrame(
        [(1, [("I'm ok", None), ("Input", "q"), ("Output", "a\nb")]), (2, [("user", "")]), (3, [])],
        "conv_id int, messages array<struct<role: string, content: string>>",
    )
    got = {r.conv_id: r.text for r in templates.render_messages(nested, keys=["conv_id"]).collect()}
    assert got == {**want, 3: ""}


def test_prompt_opens_last_turn(spark):
    turns = [(1, 1, "sys", "s"), (1, 2, "Output", "never shown"), (2, 1, "only", "x")]
    rows = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.text for r in templates.render_prompt(rows).collect()}
    assert got == {1: "[sys]\ns\n[SEP]\n[Output]\n", 2: "[only]\n"}


def test_views_scan_once(spark, tmp_path):
    path = str(tmp_path / "qa")
    spark.createDataFrame([(1, "q", "m", "h")], "id int, q string, m string, h string").write.parquet(path)
    df = projection.views(spark.read.parquet(path), {"machine": ["q", "m"], "human": ["q", "h"]}, ["id"])
    assert sorted(map(tuple, df.collect())) == [(1, "human", "q", "h"), (1, "machine", "q", "m")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_map_batches_sees_batches_and_changes_row_count(spark):
    def fn(batch):
        return {"size": [len(batch["id"])], "total": [sum(batch["id"])]}

    got = projection.map_batches(spark.range(2500).coalesce(1), fn, "size bigint, total bigint").collect()
    assert [r["size"] for r in got] == [1000, 1000, 500]
    assert sum(r.total for r in got) == sum(range(2500))


def test_column_choice(spark):
    df = spark.range(1).select("id", F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert projection.drop_columns(df, "a").columns == ["id", "b"]
    assert projection.keep_columns(df, ["b", "id"]).columns == ["b", "id"]
    try:
        projection.drop_columns(df, "zzz")
    except ValueError:
        pass
    else:
        raise AssertionError("a missing column must be an error")
