"""Applying a WordPiece vocabulary to texts, and going back from ids to text.

The usual way keeps every text in its row: texts are normalised by JVM expressions, split and looked up in Arrow batches
against a broadcast vocabulary, so the corpus is never shuffled. The vocabulary is broadcast only when it has at
most ``MAX_BROADCAST_PIECES`` usable pieces (a piece longer than a word may be is never usable, so the bytes are
bounded too). A larger one is joined: distinct words are encoded once, then joined back to the word positions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import sequences
from corpuskit.functions.text import LEGACY_SPECIALS, SPECIALS, special_mark, split_words, splittable, words
from corpuskit.operators.joins import lookup_join

MAX_BROADCAST_PIECES = 1_000_000

# Fixed value: longer words are unknown as a whole.
MAX_WORD_CHARS = 100

# Words of several pieces remembered per task between batches; the memory is emptied when full.
_MEMORY_WORDS = 100_000


def greedy_ids(word: str, ids: dict[str, int], longest: int, unknown: int) -> list[int]:
    """Longest pieces from left to right; any gap makes the whole word unknown."""
    if len(word) > MAX_WORD_CHARS:
        return [unknown]
    found, start = [], 0
    while start < len(word):
        prefix = "##" if start else ""
        for end in range(min(len(word), start + longest), start, -1):
            piece_id = ids.get(prefix + word[start:end])
            if piece_id is not None:
                found.append(piece_id)
                start = end
                break
        else:
            return [unknown]
    return found


def usable_pieces(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.char_length("piece") <= MAX_WORD_CHARS + 2).select("id", "piece")


def collect_vocab(vocab: DataFrame, limit: int = MAX_BROADCAST_PIECES) -> dict[str, int] | None:
    """The usable pieces as a dict, or None when there are more than ``limit``."""
    rows = usable_pieces(vocab).limit(limit + 1).collect()
    return {row["piece"]: row["id"] for row in rows} if len(rows) <= limit else None


def _marks(ids: dict[str, int], specials: Sequence[str]) -> dict[str, int]:
    return {special_mark(i): ids[piece] for i, piece in enumerate(specials) if piece in ids}


def _id_lookup(spark, ids: dict[str, int], specials: Sequence[str], split: bool):
    """An Arrow function to arrays of ids, from single words or, with ``split``, from ``splittable`` texts.

    The vocabulary stays an Arrow array in the tasks. A word that is no piece is walked only when its last character
    ends some continuation; for that alone a task builds a dict.
    """
    marks = _marks(ids, specials)
    pieces, numbers = pa.array([*marks, *ids], pa.string()), np.array([*marks.values(), *ids.values()], np.int32)
    ends = pa.array(sorted({piece[-1] for piece in ids if piece.startswith("##") and len(piece) > 2}), pa.string())
    shared = spark.sparkContext.broadcast((pieces, numbers, ends))
    n_marks, longest, unknown = len(marks), max(map(len, ids), default=1), ids[specials[0]]
    by_piece: dict[str, int] = {}
    memory: dict[str, list[int]] = {}

    def walked(word: str) -> list[int]:
        found = memory.get(word)
        if found is None:
            if not by_piece:
                pieces, numbers, _ = shared.value
                by_piece.update(zip(pieces[n_marks:].to_pylist(), numbers[n_marks:].tolist()))
            found = memory[word] = greedy_ids(word, by_piece, longest, unknown)
        return found

    @F.arrow_udf("array<int>")
    def lookup(column: pa.Array) -> pa.Array:
        pieces, numbers, ends = shared.value
        if len(memory) > _MEMORY_WORDS:
            memory.clear()
        if split:
            listed = split_words(column)
            starts, column = listed.offsets.to_numpy(), listed.flatten()
        else:
            starts, column = np.arange(len(column) + 1), column.fill_null("")
        coded = column.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        size = pc.utf8_length(words).to_numpy()
        place = pc.index_in(words, value_set=pieces).fill_null(-1).to_numpy()
        known = (place >= 0) & (size <= MAX_WORD_CHARS)
        several = pc.is_in(pc.utf8_slice_codeunits(words, -1), value_set=ends).to_numpy(zero_copy_only=False)
        several &= (place < 0) & (size <= MAX_WORD_CHARS)
        at = np.flatnonzero(several)
        found = [walked(word) for word in words.take(pa.array(at)).to_pylist()]
        # A text without words, and white space at either end, give an empty word without ids.
        count = (size > 0).astype(np.int64)
        count[at] = [len(entry) for entry in found]
        bounds = np.concatenate(([0], count.cumsum()))
        flat = np.full(bounds[-1], unknown, np.int32)
        flat[bounds[:-1][known]] = numbers[place[known]]
        if found:
            flat[np.repeat(several, count)] = np.concatenate(found)
        ends_of = np.concatenate(([0], count[index].cumsum()))
        if (count == 1).all():
            values = pa.array(flat[index])
        else:
            values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat).take(coded.indices).flatten()
        return pa.ListArray.from_arrays(pa.array(ends_of[starts - starts[0]], pa.int32()), values)

    # Costly: a plan must not evaluate it again in a filter that it derives, as on the size of the result.
    return lookup.asNondeterministic()


def encode(
    df: DataFrame,
    vocab: DataFrame,
    text: str = "text",
    out: str = "ids",
    keys: Sequence[str] = ("doc_id",),
    specials: Sequence[str] = SPECIALS,
    limit: int = MAX_BROADCAST_PIECES,
) -> DataFrame:
    """Content ids per row, without template pieces; special pieces written in the text keep their id.

    ``keys`` must identify a row; only the join for very large vocabularies needs them.
    """
    ids = collect_vocab(vocab, limit)
    value = F.coalesce(F.col(text), F.lit(""))
    if ids is not None:
        lookup = _id_lookup(df.sparkSession, ids, specials, split=True)
        return df.withColumn(out, lookup(splittable(value, specials)))
    return _encode_by_join(df, vocab, words(value, specials), out, list(keys), specials)


def encode_words(
    df: DataFrame,
    vocab: DataFrame,
    word: str = "word",
    specials: Sequence[str] = SPECIALS,
    limit: int = MAX_BROADCAST_PIECES,
) -> DataFrame:
    """Ids of single words: ``(word, ids)`` for a table of distinct words."""
    ids = collect_vocab(vocab, limit)
    if ids is not None:
        lookup = _id_lookup(df.sparkSession, ids, specials, split=False)
        return df.select(F.col(word).alias("word"), lookup(F.col(word)).alias("ids"))
    return _encode_words_by_join(df.select(F.col(word).alias("word")), vocab, specials)


def _encode_words_by_join(distinct: DataFrame, vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Every substring that could be a piece meets the vocabulary; the longest match per start is kept, then
    walked from the left. A word has at most 100 characters here, so its own rows are few."""
    size = F.char_length("word")
    unknown_id = F.max(F.when(F.col("piece") == specials[0], F.col("id")))
    found = usable_pieces(vocab).agg(unknown_id.alias("id"), F.max(F.char_length("piece")).alias("longest")).first()
    unknown, longest = F.lit(found["id"]), F.lit(found["longest"])
    substrings = (
        distinct.where(size <= MAX_WORD_CHARS)
        .select("word", F.explode(F.sequence(F.lit(1), size)).alias("at"))
        .select("word", "at", F.explode(F.sequence(F.lit(1), F.least(longest, size - F.col("at") + 1))).alias("len"))
        .withColumn(
            "piece",
            F.concat(F.when(F.col("at") > 1, "##").otherwise(""), F.substring("word", F.col("at"), F.col("len"))),
        )
    )
    matches = lookup_join(substrings, usable_pieces(vocab), ["piece"]).where(F.col("id").isNotNull())
    best = matches.groupBy("word", "at").agg(F.max(F.struct("len", "id")).alias("hit"))
    tables = best.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "hit"))).alias("hits")
    )

    def step(state, at):
        hit = F.element_at("hits", at)
        skip = ~state["ok"] | (at < state["next"])
        return F.when(skip, state).otherwise(
            F.struct(
                F.when(hit.isNull(), state["next"]).otherwise(at + hit["len"]).alias("next"),
                hit.isNotNull().alias("ok"),
                F.when(hit.isNull(), state["ids"]).otherwise(F.concat(state["ids"], F.array(hit["id"]))).alias("ids"),
            )
        )

    start = F.struct(
        F.lit(1).alias("next"), F.lit(True).alias("ok"), F.array().cast("array<int>").alias("ids")
    )
    walked = F.aggregate(
        F.sequence(F.lit(1), size),
        start,
        step,
        lambda s: F.when(s["ok"], s["ids"]).otherwise(F.array(unknown)),
    )
    return (
        distinct.join(tables, "word", "left")
        .withColumn("ids", F.when(F.col("hits").isNull(), F.array(unknown)).otherwise(walked))
        .select("word", "ids")
    )


def _encode_by_join(df, vocab, split: Column, out: str, keys: list[str], specials: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    placed = df.select(*keys, F.posexplode(split).alias("_pos", "word"))
    distinct = placed.select("word").distinct()
    marks = spark.createDataFrame(
        [(special_mark(i), piece) for i, piece in enumerate(specials)], "word string, piece string"
    )
    mark_ids = F.broadcast(marks).join(vocab, "piece").select("word", F.array("id").alias("ids"))
    # A stand-in whose special piece the vocabulary lacks is an unknown word like any other.
    plain = distinct.join(F.broadcast(mark_ids.select("word")), "word", "left_anti")
    table = _encode_words_by_join(plain, vocab, specials).unionByName(mark_ids)
    joined = lookup_join(placed, table, ["word"])
    # The words of one row have to meet again, since the row is the result; nothing larger is collected.
    regrouped = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "ids"))).alias("_parts"))
    ids = F.coalesce(F.flatten(F.col("_parts")["ids"]), F.array().cast("array<int>"))
    return df.join(regrouped, keys, "left").withColumn(out, ids).drop("_parts")


def encode_single(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int | None = None,
    pad_id: int | None = None,
    end: str = "[EOS]",
    **options,
) -> DataFrame:
    """Template, optional truncation and optional padding around :func:`encode`, in the order of the tokenizer.

    Special pieces have their place in the list as id. The older layout is
    ``specials=LEGACY_SPECIALS, end="[SEP]"``.
    """
    if pad_id is not None and max_length is None:
        raise ValueError("padding needs max_length")
    specials = options.get("specials", SPECIALS)
    out = options.get("out", "ids")
    ids = F.col(out)
    if max_length is not None:
        ids = sequences.truncate(ids, max_length)
    ids = sequences.single_template(ids, specials.index("[CLS]"), specials.index(end))
    if pad_id is not None:
        ids = sequences.pad(ids, max_length, pad_id)
    return encode(df, vocab, **options).withColumn(out, ids)


def encode_pair(
    df: DataFrame, vocab: DataFrame, first: str, second: str, legacy: bool = False, **options
) -> DataFrame:
    """Two texts per row as one sequence ``ids`` with ``type_ids``, 1 for the second text."""
    specials = LEGACY_SPECIALS if legacy else SPECIALS
    both = encode(df, vocab, text=first, out="_a", specials=specials, **options)
    both = encode(both, vocab, text=second, out="_b", specials=specials, **options)
    end = "[SEP]" if legacy else "[EOS]"
    places = [specials.index(piece) for piece in ("[CLS]", "[SEP]", end)]
    pair = sequences.pair_template(F.col("_a"), F.col("_b"), *places, end_type=int(legacy))
    return both.withColumn("_pair", pair).select(*df.columns, "_pair.ids", "_pair.type_ids")


def _piece_lookup(spark, by_id: dict[int, str], unknown: str):
    size = max(by_id, default=-1) + 1
    shared = spark.sparkContext.broadcast(pa.array([by_id.get(i, unknown) for i in range(size)] + [unknown], pa.string()))

    @F.arrow_udf("array<string>")
    def lookup(column: pa.Array) -> pa.Array:
        values = column.flatten().to_numpy(zero_copy_only=False)
        index = np.where((values >= 0) & (values < size), values, size)
        pieces = shared.value.take(pa.array(index, pa.int64()))
        offsets = pa.array(column.offsets.to_numpy() - column.offsets[0].as_py(), pa.int32())
        return pa.ListArray.from_arrays(offsets, pieces, mask=column.is_null())

    return lookup


def tokens(
    df: DataFrame,
    vocab: DataFrame,
    ids: str = "ids",
    out: str = "tokens",
    keys: Sequence[str] = ("doc_id",),
    unknown: str = SPECIALS[0],
    limit: int = MAX_BROADCAST_PIECES,
) -> DataFrame:
    """The pieces behind an id array, in order."""
    known = collect_vocab(vocab, limit)
    if known is not None:
        lookup = _piece_lookup(df.sparkSession, {i: piece for piece, i in known.items()}, unknown)
        return df.withColumn(out, lookup(F.col(ids)))
    placed = df.select(*keys, F.posexplode(ids).alias("_pos", "id"))
    joined = lookup_join(placed, usable_pieces(vocab), ["id"])
    entry = F.struct("_pos", F.coalesce("piece", F.lit(unknown)).alias("piece"))
    regrouped = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_parts"))
    pieces = F.coalesce(F.col("_parts")["piece"], F.array().cast("array<string>"))
    return df.join(regrouped, list(keys), "left").withColumn(out, pieces).drop("_parts")


# Blanks and phrases tidied up when pieces are joined to text.
_TIDY = (
    (" .", "."),
    (" ?", "?"),
    (" !", "!"),
    (" ,", ","),
    (" ' ", "'"),
    (" n't", "n't"),
    (" 'm", "'m"),
    (" do not", " don't"),
    (" 's", "'s"),
    (" 've", "'ve"),
    (" 're", "'re"),
)


def join_pieces(pieces: Column, specials: Sequence[str] = SPECIALS, tidy: bool = True) -> Column:
    """Pieces as text: specials left out, continuations glued on, the rest set apart by blanks."""
    kept = F.filter(pieces, lambda p: ~p.isin(*specials)) if specials else pieces

    def shown(piece: Column, index: Column) -> Column:
        text = (
            F.when(index == 0, piece)
            .when(piece.startswith("##"), F.substring(piece, F.lit(3), F.char_length(piece)))
            .otherwise(F.concat(F.lit(" "), piece))
        )
        for raw, clean in _TIDY if tidy else ():
            text = F.replace(text, F.lit(raw), F.lit(clean))
        return text

    return F.array_join(F.transform(kept, shown), "")


def decode(
    df: DataFrame,
    vocab: DataFrame,
    ids: str = "ids",
    out: str = "decoded",
    keys: Sequence[str] = ("doc_id",),
    specials: Sequence[str] = SPECIALS,
    tidy: bool = True,
    **options,
) -> DataFrame:
    """Text from ids; special pieces are skipped."""
    shown = tokens(df, vocab, ids, "_tokens", keys, specials[0], **options)
    return shown.withColumn(out, join_pieces(F.col("_tokens"), specials, tidy)).drop("_tokens")
