"""Word counts, piece alphabets, pair counts and vocabulary tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import SPECIALS, split_words, splittable

# Fixed value: vocabulary size of the tokenizer, special pieces included.
VOCAB_SIZE = 30522 * 5

VOCAB_SCHEMA = "id int, piece string, kind string"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each normalised word occurs; counted per Arrow batch and map-side before the shuffle. Also runs on streams."""

    def counted(batches):
        for batch in batches:
            found = pc.value_counts(split_words(batch.column(0)).flatten())
            kept = found.filter(pc.not_equal(found.field("values"), ""))
            yield pa.RecordBatch.from_arrays([kept.field("values"), kept.field("counts")], ["word", "n"])

    texts = df.select(splittable(F.col(text)).alias("words"))
    return texts.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def initial_pieces(word: Column) -> Column:
    """The characters of a word; all but the first carry the continuation prefix."""
    return F.transform(
        F.split(word, ""), lambda ch, i: F.when(i == 0, ch).otherwise(F.concat(F.lit("##"), ch))
    )


def alphabet(counts: DataFrame) -> DataFrame:
    """Initial pieces with their weighted counts."""
    return (
        counts.select(F.explode(initial_pieces(F.col("word"))).alias("piece"), "n")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
    )


def base_pieces(counts: DataFrame) -> DataFrame:
    """Pieces a trained vocabulary starts from: every character bare, and prefixed where it continues a word.

    Their order is by ``continues`` and piece: bare characters first, then prefixed ones, each by code point.
    """
    bare = counts.select(F.explode(F.split("word", "")).alias("piece"))
    return (
        bare.unionByName(alphabet(counts).select("piece"))
        .distinct()
        .withColumn("continues", (F.char_length("piece") > 1).cast("int"))
    )


def pair_counts(pieces: DataFrame, column: str = "pieces") -> DataFrame:
    """Counts of adjacent pieces ``(a, b)``, weighted by the word count ``n``."""
    pairs = F.arrays_zip(
        F.slice(column, 1, F.size(column) - 1).alias("a"), F.slice(column, 2, F.size(column) - 1).alias("b")
    )
    return (
        pieces.where(F.size(column) > 1)
        .select(F.inline(pairs).alias("a", "b"), "n")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n"))
    )


def special_rows(spark: SparkSession, specials: Sequence[str] = SPECIALS) -> DataFrame:
    rows = [(i, piece, "special") for i, piece in enumerate(specials)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def build_vocab(pieces: DataFrame, size: int = VOCAB_SIZE, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """A vocabulary from counted pieces ``(piece, n)``: specials first, then by count and piece up to ``size`` ids."""
    order = [F.desc("n"), F.asc("piece")]
    # Only the pieces kept are sorted through: every task hands on that many at most.
    top = pieces.select("piece", "n").orderBy(*order).limit(max(0, size - len(specials)))
    kept = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        (F.col("rank") + F.lit(len(specials) - 1)).cast("int").alias("id"), "piece", F.lit("piece").alias("kind")
    )
    return special_rows(pieces.sparkSession, specials).unionByName(kept)


def word_vocab(counts: DataFrame, k: int, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """The ``k`` most frequent whole words behind the specials."""
    return build_vocab(counts.select(F.col("word").alias("piece"), "n"), k + len(specials), specials)


def fragment_counts(counts: DataFrame, prefix: int = 4, inner: int = 3) -> DataFrame:
    """Counts of word beginnings up to ``prefix`` and continuations up to ``inner`` characters."""
    size = F.char_length("word")
    heads = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(prefix), size)), lambda k: F.substring("word", F.lit(1), k)
    )
    inners = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.greatest(size, F.lit(2))),
            lambda p: F.transform(
                F.sequence(F.lit(1), F.greatest(F.least(F.lit(inner), size - p + 1), F.lit(1))),
                lambda k: F.concat(F.lit("##"), F.substring("word", p, k)),
            ),
        )
    )
    fragments = F.when(size > 1, F.concat(heads, inners)).otherwise(heads)
    return (
        counts.select(F.explode(fragments).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    )


def vocab_size(vocab: DataFrame) -> int:
    return vocab.count()


def check_vocab(vocab: DataFrame) -> DataFrame:
    """Raise unless ids are 0..V-1 once each and pieces are unique."""
    found = vocab.agg(
        F.count("*").alias("n"),
        F.countDistinct("id").alias("ids"),
        F.countDistinct("piece").alias("pieces"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
    ).first()
    if not (found.n == found.ids == found.pieces and found.low == 0 and found.high == found.n - 1):
        raise ValueError(f"not a vocabulary: {found.asDict()}")
    return vocab


def save_vocab(vocab: DataFrame, path: str) -> None:
    check_vocab(vocab).write.mode("errorifexists").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return check_vocab(spark.read.schema(VOCAB_SCHEMA).parquet(path))


def read_tokenizer_json(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary of a tokenizer file: pieces and ids of its model, special where the file lists them as added."""
    file = spark.read.text(path, wholetext=True)
    added = "array<struct<id: int, content: string, special: boolean>>"
    parts = file.select(
        F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string, int>").alias("pieces"),
        F.from_json(F.get_json_object("value", "$.added_tokens"), added).alias("added"),
    )
    special = F.transform(F.filter("added", lambda x: x["special"]), lambda x: x["content"])
    listed = parts.select(F.explode("pieces").alias("piece", "id"), F.coalesce(special, F.array()).alias("special"))
    kind = F.when(F.array_contains("special", F.col("piece")), "special").otherwise("piece")
    return check_vocab(listed.select("id", "piece", kind.alias("kind")))


def tokenizer_json(vocab: DataFrame) -> str:
    """The text of a tokenizer file with this vocabulary; one row, as a vocabulary is bounded."""
    entry = F.struct("id", "piece", "kind")
    pieces = json.loads(check_vocab(vocab).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("rows")).first()["rows"])
    specials = [p for p in pieces if p["kind"] == "special"]
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [{"id": p["id"], "content": p["piece"], **flags} for p in specials],
            "normalizer": {
                "type": "Sequence",
                "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}, {"type": "StripAccents"}],
            },
            "pre_tokenizer": {"type": "Whitespace"},
            "post_processor": None,
            "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
            "model": {
                "type": "WordPiece",
                "unk_token": pieces[0]["piece"],
                "continuing_subword_prefix": "##",
                "max_input_chars_per_word": 100,
                "vocab": {p["piece"]: p["id"] for p in pieces},
            },
        },
        ensure_ascii=False,
    )
