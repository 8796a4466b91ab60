import os
import random
import tracemalloc

import models
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators import encoding, joins, vocabulary

PIECES = ["the", "##re", "##n", "t", "##h", "##e", "a", "##a", "##b", "##c", "b", "hel", "##lo", "你", "##好", ".", "'", "!", "#", "##", "###", "가", "x" * 60, "##" + "x" * 41, "sep", "[", "]"]
TEXTS = [
    "",
    "The there then thex abc",
    "hello. 'a' !",
    "x" * 100 + " " + "x" * 101 + " " + "x" * 60,
    "가 가나 你好 好你",
    "a[SEP]b [PAD] [sep] [UNK]",
    "### #### \"### a#b",
    "  \n",
    "ABC äbc",
]


@pytest.fixture(scope="module")
def vocab(spark):
    rows = list(tx.SPECIALS) + PIECES
    kinds = ["special"] * len(tx.SPECIALS) + ["piece"] * len(PIECES)
    return spark.createDataFrame([(i, p, k) for i, (p, k) in enumerate(zip(rows, kinds))], vocabulary.VOCAB_SCHEMA).cache()


@pytest.fixture(scope="module")
def library(vocab):
    lib = pytest.importorskip("tokenizers")
    tok = lib.Tokenizer(lib.models.WordPiece({r.piece: r.id for r in vocab.collect()}, unk_token="[UNK]"))
    tok.normalizer = lib.normalizers.Sequence(
        [lib.normalizers.NFD(), lib.normalizers.Lowercase(), lib.normalizers.StripAccents()]
    )
    tok.pre_tokenizer = lib.pre_tokenizers.Whitespace()
    tok.add_special_tokens(list(tx.SPECIALS))
    tok.post_processor = lib.processors.TemplateProcessing(
        single="[CLS] $A [EOS]", pair="[CLS] $A [SEP] $B:1 [EOS]", special_tokens=[(p, i) for i, p in enumerate(tx.SPECIALS)]
    )
    tok.decoder = lib.decoders.WordPiece()
    return tok


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    extra = ["".join(rng.choice("thenabc .!'#[]SEP你好é") for _ in range(rng.randrange(60))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(TEXTS + extra)), "doc_id int, text string").cache()


@pytest.mark.parametrize("limit", [encoding.MAX_BROADCAST_PIECES, 3])
def test_encode_matches_library_on_both_paths(rows, vocab, library, limit):
    got = encoding.encode_single(rows.repartition(4), vocab, limit=limit).collect()
    for r in got:
        assert r.ids == library.encode(r.text).ids, r.text
    assert len(got) == rows.count()


@pytest.mark.parametrize("limit", [encoding.MAX_BROADCAST_PIECES, 3])
def test_tokens_and_decode_match_library(rows, vocab, library, limit):
    encoded = encoding.encode_single(rows, vocab)
    shown = encoding.tokens(encoded, vocab, limit=limit)
    for r in encoding.decode(shown, vocab, limit=limit).collect():
        assert r.tokens == library.encode(r.text).tokens
        assert r.decoded == library.decode(r.ids), r.text


def test_truncation_and_padding_match_library(rows, vocab, library):
    library.enable_truncation(max_length=12)
    library.enable_padding(length=12, pad_id=3, pad_token="[PAD]")
    try:
        for r in encoding.encode_single(rows, vocab, max_length=12, pad_id=3).collect():
            assert r.ids == library.encode(r.text).ids
    finally:
        library.no_truncation()
        library.no_padding()


@pytest.mark.parametrize("limit", [encoding.MAX_BROADCAST_PIECES, 3])
def test_pairs_match_library(rows, vocab, library, limit):
    pairs = rows.withColumn("other", F.reverse("text"))
    for r in encoding.encode_pair(pairs, vocab, "text", "other", limit=limit).collect():
        want = library.encode(r.text, r.other)
        assert (r.ids, r.type_ids) == (want.ids, want.type_ids)


def test_older_layout(spark):
    pieces = list(tx.LEGACY_SPECIALS) + ["a", "b"]
    old = spark.createDataFrame([(i, p, "piece") for i, p in enumerate(pieces)], vocabulary.VOCAB_SCHEMA)
    df = spark.createDataFrame([(1, "a b[PAD]", "b")], "doc_id int, text string, other string")
    single = encoding.encode_single(df, old, max_length=8, pad_id=3, end="[SEP]", specials=tx.LEGACY_SPECIALS)
    assert single.first().ids == [1, 5, 6, 3, 2, 3, 3, 3]
    pair = encoding.encode_pair(df, old, "text", "other", legacy=True).first()
    assert (pair.ids, pair.type_ids) == ([1, 5, 6, 3, 2, 6, 2], [0, 0, 0, 0, 0, 1, 1])


def test_null_text_counts_as_empty(spark, vocab):
    df = spark.createDataFrame([(1, None)], "doc_id int, text string")
    for limit in (encoding.MAX_BROADCAST_PIECES, 3):
        assert encoding.encode(df, vocab, limit=limit).first().ids == []


def test_words_match_literal_model(spark, vocab):
    ids = {r.piece: r.id for r in vocab.collect()}
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("thenabcxlo你好") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"x" * 101})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {w: models.greedy(w, ids) for w in words}
    for limit in (encoding.MAX_BROADCAST_PIECES, 3):
        assert {r.word: r.ids for r in encoding.encode_words(df, vocab, limit=limit).collect()} == want


def test_encoding_keeps_texts_in_place(rows, vocab):
    plan = encoding.encode(rows, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_decode_without_specials_is_normalised_text(spark, vocab):
    df = spark.createDataFrame([(1, "There the abc")], "doc_id int, text string")
    encoded = encoding.encode_single(df, vocab)
    assert encoding.decode(encoded, vocab).first().decoded == "there the abc"


def test_hot_keys_are_bounded_and_joined_once(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert [r.k for r in joins.hot_keys(left, ["k"], 1).collect()] == [0]
    got = joins.lookup_join(left, right, ["k"], joins.hot_keys(left, ["k"], 2))
    want = left.join(right, "k", "left")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_is_spread_over_partitions(spark):
    rows = spark.range(40000).select(F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(40000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = joins.lookup_join(rows, table, ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40000 and max(sizes) < 40000 / 4
        assert joined.where("v <> 2 * k").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_both_ways_agree_on_odd_vocabularies_and_texts(spark):
    pieces = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "a", "b", "c" * 120]
    old = spark.createDataFrame([(i, p, "piece") for i, p in enumerate(pieces)], vocabulary.VOCAB_SCHEMA)
    texts = ["a b [EOS] a", "", None, "a \ufdd3 b\ufdd0", "[SEP] a", "c" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    both = [
        {r.doc_id: r.ids for r in encoding.encode(df, old, limit=limit).collect()}
        for limit in (encoding.MAX_BROADCAST_PIECES, 3)
    ]
    assert both[0] == both[1] and both[0][0] == [5, 6, 0, 5] and both[0][3] == [5, 0, 6, 0] and both[0][5] == [0]
    coded = spark.createDataFrame([(1, [5, 7, 99])], "doc_id int, ids array<int>")
    shown = [encoding.tokens(coded, old, limit=limit).first().tokens for limit in (encoding.MAX_BROADCAST_PIECES, 3)]
    assert shown[0] == shown[1] == ["a", "[UNK]", "[UNK]"]


def test_padding_needs_a_length(rows, vocab):
    with pytest.raises(ValueError):
        encoding.encode_single(rows, vocab, pad_id=3)


def test_lookup_of_many_words_holds_no_python_objects_for_them(spark):
    # A worker remembered up to 500,000 words, and held the vocabulary as a dict.
    pieces = [*tx.SPECIALS, *(f"w{i}" for i in range(150_000))]
    lookup = encoding._id_lookup(spark, {p: i for i, p in enumerate(pieces)}, tx.SPECIALS, split=False).func
    column = pa.array([f"w{i}" for i in range(300_000)] + ["", None])
    tracemalloc.start()
    try:
        ids = lookup(column)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    del column
    assert held < 8_000_000
    assert ids[7].as_py() == [13] and ids[200_000].as_py() == [0] and ids[300_000].as_py() == ids[300_001].as_py() == []


def test_words_that_end_like_a_continuation_are_walked(spark):
    rows = [*tx.SPECIALS, "###", "ab", "w" * 101]
    vocab = spark.createDataFrame([(i, p, "piece") for i, p in enumerate(rows)], vocabulary.VOCAB_SCHEMA)
    df = spark.createDataFrame([(0, "#### ab abc ###ab [SEP] " + "w" * 101)], "doc_id int, text string")
    want = [6, 6, 7, 0, 6, 7, 2, 0]
    assert encoding.encode(df, vocab).first().ids == want


def test_listed_rows_counts_lookups_and_fits_share_their_workers(spark):
    """Python as each of them runs it; a worker's parent is the daemon of its pool. Listed rows, as the special pieces of a
    vocabulary, come through a Python RDD."""

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getppid()] * batch.num_rows, pa.int64())], ["pid"])

    def fitted(frames):
        for frame in frames:
            yield frame.assign(pid=os.getppid())[["pid"]]

    @F.arrow_udf("bigint")
    def looked_up(column: pa.Array) -> pa.Array:
        return pa.array([os.getppid()] * len(column), pa.int64())

    rows = spark.range(20)
    made = [rows.mapInArrow(counted, "pid bigint"), rows.select(looked_up("id")), rows.mapInPandas(fitted, "pid bigint")]
    pools = {r[0] for df in made for r in df.collect()}
    assert pools == set(spark.sparkContext.parallelize(range(20)).map(lambda _: os.getppid()).collect())
