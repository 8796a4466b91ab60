import random
import unicodedata

import pytest
from models import folded
from pyspark.sql import functions as F

from corpuskit.functions import text as tx

SMOKE = [
    "Hello, y'all! How are you 😁 ?",
    "你好， 你还好吗？",
    "Hello Hi Bad 你好 嗨 How",
    "ΟΔΟΣ Σίσυφος İstanbul ǅ ﬁ ÀÉÎõü Ørsted ßtraße",
    "가나다 각 힣 한국어 text",
    "a½b x²y a b a　b ⅷ Ⓐb c‍d é_e ١٢ !!aःb",
    "",
    "  \t\n ",
    "á!́!",
]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def test_normalize_matches_definition(spark):
    got = texts(spark, SMOKE).select("i", tx.normalize(F.col("text")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [folded(s) for s in SMOKE]


def test_normalize_every_character(spark):
    chars = [
        chr(cp)
        for cp in range(1, 0x110000)
        if unicodedata.category(chr(cp)) not in ("Cs", "Cn")
    ]
    rows = [(i, f"x{c}") for i, c in enumerate(chars)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", tx.normalize(F.col("text")).alias("t")).collect()
    wrong = [hex(ord(chars[r.i])) for r in got if r.t != folded(f"x{chars[r.i]}")]
    assert wrong == []


def test_words_match_tokenizer_library(spark):
    lib = pytest.importorskip("tokenizers")
    norm = lib.normalizers.Sequence(
        [lib.normalizers.NFD(), lib.normalizers.Lowercase(), lib.normalizers.StripAccents()]
    )
    split = lib.pre_tokenizers.Whitespace()
    rng = random.Random(5)
    alphabet = "aZé_9²½ \t 　!?.,'#[]你，가ⅷⒶ😁́‍١ßΣ"
    values = SMOKE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = texts(spark, values).select("i", tx.words(F.col("text")).alias("w")).orderBy("i").collect()
    for row, value in zip(got, values):
        assert row.w == [w for w, _ in split.pre_tokenize_str(norm.normalize_str(value))], value


def test_written_specials_become_words(spark):
    value = "a[SEP]b [sep] [PAD][CLS]"
    row = texts(spark, [value]).select(tx.words(F.col("text"), tx.SPECIALS).alias("w")).first()
    assert row.w == ["a", tx.special_mark(2), "b", "[", "sep", "]", tx.special_mark(4), tx.special_mark(1)]


def test_hash_fraction_is_uniform_and_stable(spark):
    df = spark.range(20000).select("id", tx.hash_fraction(3, F.col("id")).alias("f"))
    low = df.where("f < 0.1").count()
    assert 1800 < low < 2200
    assert df.where("f < 0 or f >= 1").count() == 0
    assert df.repartition(7).where("f < 0.1").count() == low


def test_split_words_are_words_for_every_latin_character_and_mark(spark):
    # Marks and white space differ between Java and RE2; every character meets letters, marks, blanks and itself here.
    near = [chr(c) for c in [*range(0x01, 0x250), *range(0x2000, 0x2070), 0x20AC, 0x3000, 0x4F60, 0x1F600, 0xFDD0, 0xAC00]]
    values = [f"a{c}b {c} .{c}. {c}{c}x{c}" for c in near] + ["", "  \n", "[SEP]a", "“a–b” [SEP]… ß。", " x", "x\u000by\u001cz"]
    df = texts(spark, values)
    for specials in (None, tx.SPECIALS):
        text = F.col("text")

        @F.arrow_udf("array<string>")
        def split(column):
            return tx.split_words(column)

        got = df.select("i", tx.words(text, specials).alias("want"), split(tx.splittable(text, specials)).alias("got")).collect()
        for r in got:
            assert [w for w in r.got if w] == r.want, values[r.i]
    assert [r[0] for r in texts(spark, ["é ß“", "你", "a b"]).orderBy("i").select(tx.splittable(F.col("text"))["plain"]).collect()] == [True, False, False]
