"""The row-wise operators and counts on Structured Streaming inputs.

Rendering, normalising, encoding, windows, the hash split and the integer-weight mixture are row expressions and
take a streaming frame as it is. Word and pair counts are streaming aggregations. Operators that need the whole table
(exact split, ranks, training) belong on the written result of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpuskit.operators import ngrams, vocabulary


def read_stream(
    spark: SparkSession, path: str, schema: str, format: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows of a row-wise plan, exactly once, for all input there is."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def word_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """Running word counts as a streaming aggregation."""
    return vocabulary.word_counts(stream, text)


def bigram_counts(stream: DataFrame, ids: str = "ids") -> DataFrame:
    """Running pair counts as a streaming aggregation."""
    return ngrams.bigram_counts(stream, ids)


def keep_totals(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed totals of every micro-batch to ``path/batch=<id>``; the newest row per key counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(counts, write, checkpoint, "update")


def each_batch(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run a batch plan on every micro-batch, for operators that regroup rows."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(fn)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
