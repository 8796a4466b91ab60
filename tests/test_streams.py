from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators import encoding, mixing, splitting, templates, vocabulary, windows
from corpuskit.streaming import streams

SCHEMA = "doc_id bigint, text string"


def source(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i, f"The word{i % 7} É and THE {'tail ' * (i % 5)}") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    return path, spark.read.parquet(path)


def row_wise(df, vocab):
    rendered = templates.render_fields(df, ["text"], keys=["doc_id"])
    encoded = encoding.encode_single(rendered, vocab)
    cut = windows.segment(encoded, 8, 2)
    return splitting.split_hash(cut, ["doc_id"], 0.2)


def test_row_wise_plan_on_a_stream(spark, tmp_path):
    path, batch = source(spark, tmp_path)
    vocab = vocabulary.word_vocab(vocabulary.word_counts(batch), 20)
    stream = streams.read_stream(spark, path, SCHEMA, max_files=2)
    query = streams.append_rows(row_wise(stream, vocab), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 3
    got, want = spark.read.parquet(str(tmp_path / "out")), row_wise(batch, vocab)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()


def test_mixture_on_a_stream(spark, tmp_path):
    path, batch = source(spark, tmp_path)
    tagged = lambda df: mixing.mixture(df.withColumn("source", F.lit("s")), {"s": 2})
    query = streams.append_rows(tagged(streams.read_stream(spark, path, SCHEMA)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120 == tagged(batch).count()


def test_word_and_pair_counts_on_a_stream(spark, tmp_path):
    path, batch = source(spark, tmp_path)
    stream = streams.read_stream(spark, path, SCHEMA, max_files=2)
    query = streams.keep_totals(streams.word_counts(stream), str(tmp_path / "words"), str(tmp_path / "cp1"))
    query.awaitTermination(120)
    totals = spark.read.parquet(str(tmp_path / "words")).groupBy("word").agg(F.max_by("n", "batch").alias("n"))
    want = vocabulary.word_counts(batch)
    assert totals.exceptAll(want).count() == 0 and want.exceptAll(totals).count() == 0
    lengths = stream.select(F.transform(tx.words(F.col("text")), lambda w: F.char_length(w)).alias("ids"))
    query = streams.keep_totals(streams.bigram_counts(lengths), str(tmp_path / "pairs"), str(tmp_path / "cp2"))
    query.awaitTermination(120)
    pairs = spark.read.parquet(str(tmp_path / "pairs")).groupBy("a", "b").agg(F.max_by("n", "batch").alias("n"))
    assert pairs.agg(F.sum("n")).first()[0] == batch.select(F.sum(F.size(tx.words(F.col("text"))) - 1)).first()[0]


def test_regrouping_operator_per_micro_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(c, t, "user", f"{c}-{t}") for c in range(6) for t in range(3)], "conv_id int, turn int, role string, text string").coalesce(1).write.parquet(path)
    stream = streams.read_stream(spark, path, "conv_id int, turn int, role string, text string")

    def write(batch, batch_id):
        templates.render_chat(batch).write.mode("overwrite").parquet(f"{tmp_path}/chat/batch={batch_id}")

    streams.each_batch(stream, write, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/chat").count() == 6
