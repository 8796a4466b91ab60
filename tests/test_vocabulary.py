import random
from collections import Counter

import models
import pytest

from corpuskit.functions import text as tx
from corpuskit.operators import vocabulary, wordpiece


def corpus(seed, distinct, letters="abcde"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(distinct)}
    return {w: rng.randrange(1, 50) for w in sorted(words)}


def counts_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def test_word_counts(spark):
    df = spark.createDataFrame([("A b a!",), ("",), ("b\nB",)], "text string")
    assert {r.word: r.n for r in vocabulary.word_counts(df).collect()} == {"a": 2, "b": 3, "!": 1}


def test_alphabet_and_pairs(spark):
    counts = corpus(1, 60)
    df = counts_frame(spark, counts)
    letters, pairs = Counter(), Counter()
    for w, n in counts.items():
        pieces = [w[0]] + ["##" + c for c in w[1:]]
        for p in pieces:
            letters[p] += n
        for pair in zip(pieces, pieces[1:]):
            pairs[pair] += n
    assert {r.piece: r.n for r in vocabulary.alphabet(df).collect()} == letters
    split = df.select(vocabulary.initial_pieces(df.word).alias("pieces"), "n")
    assert {(r.a, r.b): r.n for r in vocabulary.pair_counts(split).collect()} == pairs


def test_build_vocab_orders_by_count_then_piece(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "piece string, n bigint")
    rows = vocabulary.build_vocab(df, 9).orderBy("id").collect()
    assert [r.piece for r in rows] == list(tx.SPECIALS) + ["c", "a", "b"]
    old = vocabulary.build_vocab(df, 9, tx.LEGACY_SPECIALS).orderBy("id").collect()
    assert [r.piece for r in old] == list(tx.LEGACY_SPECIALS) + ["c", "a", "b", "d"]


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([("b", 3), ("a", 3)], "piece string, n bigint")
    vocab = vocabulary.build_vocab(df, 100)
    vocabulary.save_vocab(vocab, str(tmp_path / "v"))
    loaded = vocabulary.load_vocab(spark, str(tmp_path / "v"))
    assert vocabulary.vocab_size(loaded) == 8
    assert loaded.exceptAll(vocab).count() == 0
    with pytest.raises(Exception):
        vocabulary.save_vocab(vocab, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        vocabulary.check_vocab(vocab.where("id <> 3"))


@pytest.mark.parametrize("seed,letters", [(1, "abcde"), (2, "ab"), (3, "abc#"), (4, "aéß你b")])
def test_training_equals_one_merge_at_a_time(spark, seed, letters):
    counts = corpus(seed, 80, letters)
    rounds = []
    vocab = wordpiece.train_wordpiece(counts_frame(spark, counts), 60, on_round=rounds.append)
    got = [r.piece for r in vocab.orderBy("id").collect()]
    assert got == models.wordpiece(counts, 60, tx.SPECIALS)
    assert sum(map(len, rounds)) >= len(rounds)
    vocabulary.check_vocab(vocab)


@pytest.mark.parametrize("seed,letters,heavy", [(5, "abc", 3), (6, "ab#", 1), (7, "abcde", 12)])
def test_training_with_few_counted_pairs(spark, seed, letters, heavy):
    counts = corpus(seed, 60, letters)
    vocab = wordpiece.train_wordpiece(counts_frame(spark, counts), 45, heavy=heavy)
    assert [r.piece for r in vocab.orderBy("id").collect()] == models.wordpiece(counts, 45, tx.SPECIALS)


def test_rounds_take_several_merges_when_that_is_exact():
    rows = [
        {"a": "a", "b": "##b", "n": 100, "around": 10},
        {"a": "c", "b": "##d", "n": 90, "around": 5},
        {"a": "##b", "b": "##e", "n": 80, "around": 0},
        {"a": "x", "b": "##y", "n": 70, "around": 0},
    ]
    assert wordpiece.choose_merges(rows, set(), 10) == [("a", "##b"), ("c", "##d")]
    assert wordpiece.choose_merges(rows, set(), 1) == [("a", "##b")]
    assert wordpiece.choose_merges(rows, {"ab"}, 10) == [("a", "##b")]
    assert wordpiece.choose_merges(rows, set(), 10, relax=0.5) == [("a", "##b"), ("c", "##d"), ("x", "##y")]
    rows[0]["around"] = 90
    assert wordpiece.choose_merges(rows, set(), 10) == [("a", "##b")]


def test_training_stops_when_nothing_is_left(spark):
    vocab = wordpiece.train_wordpiece(counts_frame(spark, {"abc": 2, "ab": 1}), 1000)
    assert [r.piece for r in vocab.orderBy("id").collect()] == list(tx.SPECIALS) + ["a", "b", "c", "##b", "##c", "ab", "abc"]


def test_training_agrees_with_library_where_counts_decide(spark):
    lib = pytest.importorskip("tokenizers")
    # Powers of three keep all pair counts apart, so no tie has to be broken.
    words = ["then", "them", "aback", "cabin", "zoo", "fox", "wig"]
    counts = {w: 3**i for i, w in enumerate(words)}
    tok = lib.Tokenizer(lib.models.WordPiece(unk_token="[UNK]"))
    tok.pre_tokenizer = lib.pre_tokenizers.Whitespace()
    base = len(models.wordpiece(counts, 0, tx.SPECIALS))
    size = base + 6
    trainer = lib.trainers.WordPieceTrainer(vocab_size=size, special_tokens=list(tx.SPECIALS), show_progress=False)
    tok.train_from_iterator((" ".join([w] * n) for w, n in counts.items()), trainer=trainer)
    mine = wordpiece.train_wordpiece(counts_frame(spark, counts), size)
    literal = models.wordpiece(counts, size, tx.SPECIALS)
    assert [r.piece for r in mine.orderBy("id").collect()] == literal
    assert set(tok.get_vocab()) >= set(literal[:base])
    assert len(tok.get_vocab()) == len(literal)


def test_relaxed_training_is_close_on_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    counts = vocabulary.word_counts(docs).cache()
    exact, quick = [], []
    want = {r.piece for r in wordpiece.train_wordpiece(counts, 260, on_round=exact.append).collect()}
    got = {r.piece for r in wordpiece.train_wordpiece(counts, 260, relax=0.9, on_round=quick.append).collect()}
    assert len(got) == len(want) == 260 and len(quick) < len(exact)
    assert len(got & want) >= 250


def test_tokenizer_file_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(1, "the theme of there"), (2, "Ähre")], "doc_id int, text string")
    vocab = vocabulary.word_vocab(vocabulary.word_counts(docs), 4)
    path = tmp_path / "tokenizer.json"
    path.write_text(vocabulary.tokenizer_json(vocab), encoding="utf-8")
    read = vocabulary.read_tokenizer_json(spark, str(path))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, vocab.collect()))
    ids = {r.piece: r.id for r in vocab.collect()}
    assert Tokenizer.from_file(str(path)).encode("THE zzz [SEP]").ids == [ids["the"], 0, 2]
