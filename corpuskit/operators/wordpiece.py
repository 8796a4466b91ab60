"""Training a WordPiece vocabulary by frequency-greedy pair merging.

The state is a table of distinct words with their counts and their current pieces, and a table of counted pairs with
their neighbours. A round brings the best few hundred pairs to the driver, picks as many merges as are certain to be
the next ones of the one-at-a-time procedure, rewrites the words in one pass without a shuffle, and adds to the counted
pairs what the changed words, which that pass marks, gained and lost. How a round can take several merges and stay
exact:

* Merging (a, b) changes the count of a pair only if that pair ends in ``a`` or begins with ``b``.
* Every pair that the merge creates lies inside an occurrence of ``x a b`` or ``a b y``, so its count is at
  most the largest count of such a triple. The same aggregation delivers these triple counts.

So the next pair in count order is the next merge for sure while it is untouched by the merges chosen so far and
its count is above all their triple counts. ``relax`` below 1 multiplies the bound of the second test and skips
touched pairs instead of stopping. On the words of a 200-document corpus, 400 merges took 37 exact rounds; with
``relax=0.9`` it was 11 rounds and 98% of the pieces, with 0.5 it was 6 rounds and 92%.

Only the commonest pairs are kept counted, those above a floor. Merges only lower the count of any other pair of pieces
that were there when the floor was set, and pairs with a newer piece occur in changed words alone. So all pairs above
the floor stay counted exactly until none is left there, or until a merge makes a piece that was there before; then all
words are counted again and a new floor is set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import SPECIALS
from corpuskit.operators.vocabulary import (
    VOCAB_SCHEMA,
    VOCAB_SIZE,
    base_pieces,
    initial_pieces,
    special_rows,
)
from corpuskit.session import Stage, write_stage

# About so many of the commonest pairs are kept counted between full counts.
HEAVY_PAIRS = 1 << 16

# Pieces of a word are kept as " p1  p2  p3 ": each piece has its own blanks, so one literal replacement of
# " a  b " by " ab " merges from left to right without overlaps. Words hold no blanks.


# A word that has become one piece holds no pair any more and leaves the state.
_OPEN = "contains(packed, '  ')"


def packed_pieces(word: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(initial_pieces(word), "  "), F.lit(" "))


def unpacked_pieces(packed: Column) -> Column:
    return F.split(F.replace(F.trim(packed), F.lit("  "), F.lit(" ")), " ")


def merged_piece(a: str, b: str) -> str:
    return a + b.removeprefix("##")


def _apply(packed: Column, merges: Sequence[tuple[str, str]]) -> Column:
    steps = F.array(
        *[
            F.struct(F.lit(f" {a}  {b} ").alias("pair"), F.lit(f" {merged_piece(a, b)} ").alias("piece"))
            for a, b in merges
        ]
    )
    return F.aggregate(steps, packed, lambda text, step: F.replace(text, step["pair"], step["piece"]))


def _triples(words: DataFrame) -> DataFrame:
    """``(a, b, side, c, n)`` of ``(packed, n)``: every adjacent pair with the piece after it (side 1) and before (0)."""
    pieces = words.select(unpacked_pieces(F.col("packed")).alias("p"), "n").where(F.size("p") > 1)
    none = F.array(F.lit(None).cast("string"))
    around = F.arrays_zip(
        F.slice("p", 1, F.size("p") - 1).alias("a"),
        F.slice("p", 2, F.size("p") - 1).alias("b"),
        F.concat(none, F.slice("p", 1, F.size("p") - 2)).alias("before"),
        F.concat(F.slice("p", 3, F.size("p") - 2), none).alias("after"),
    )
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("after").alias("c")),
        F.struct(F.lit(0).alias("side"), F.col("before").alias("c")),
    )
    return pieces.select(F.inline(around).alias("a", "b", "before", "after"), "n").select(
        "a", "b", F.inline(sides).alias("side", "c"), "n"
    )


def _summed(triples: DataFrame) -> DataFrame:
    return triples.groupBy("a", "b", "side", "c").agg(F.sum("n").alias("n")).where("n > 0")


def _pairs(triples: DataFrame) -> DataFrame:
    """Pairs with their count and the largest count of a triple around them."""
    return triples.groupBy("a", "b").agg(
        F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("n"),
        F.coalesce(F.max(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("around"),
    )


def _counted(words: DataFrame, heavy: int) -> tuple[Stage, int]:
    """Triples of the commonest pairs, about ``heavy`` of them, and the floor that their counts are above."""
    every = write_stage(_summed(_triples(words)), "triples")
    pairs = _pairs(every.df)
    step = F.floor(F.log2("n") * 8).alias("step")
    steps = pairs.groupBy(step).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step"))
    kept, floor = 0, 0
    for row in steps.collect():  # eight rows per doubling of the count
        if kept and kept + row["pairs"] > heavy:
            break
        kept, floor = kept + row["pairs"], row["least"] - 1
    else:
        return every, 0
    stage = write_stage(every.df.join(pairs.where(F.col("n") > floor).select("a", "b"), ["a", "b"]), "triples")
    every.drop()
    return stage, floor


def _rewritten(words: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """Words after the merges, with what they were ``before`` where that differs."""
    moved = words.where(_OPEN).select("n", F.col("packed").alias("before"), _apply(F.col("packed"), merges).alias("packed"))
    return moved.select("n", "packed", F.when(F.col("before") != F.col("packed"), F.col("before")).alias("before"))


def _changes(words: DataFrame) -> DataFrame:
    """Triples that changed words gained, and with negative counts those they lost."""
    changed = words.where("before IS NOT NULL")
    both = F.array(
        F.struct(F.col("before").alias("packed"), (-F.col("n")).alias("n")), F.struct(F.col("packed"), F.col("n"))
    )
    return _triples(changed.select(F.inline(both).alias("packed", "n")))


def choose_merges(candidates: Sequence, known: set[str], room: int, relax: float = 1.0) -> list[tuple[str, str]]:
    """The merges of one round, from pairs in count order."""
    chosen, lefts, rights, made, bound = [], set(), set(), set(), 0
    for row in candidates:
        if len(made) >= room or (chosen and row["n"] <= relax * bound):
            break
        if row["a"] in rights or row["b"] in lefts:
            if relax >= 1:
                break
            continue
        piece = merged_piece(row["a"], row["b"])
        chosen.append((row["a"], row["b"]))
        lefts.add(row["a"])
        rights.add(row["b"])
        bound = max(bound, row["around"])
        if piece in known or piece in made:
            # Pairs around an existing piece gain occurrences, so count again before going on.
            break
        made.add(piece)
    return chosen


def train_wordpiece(
    counts: DataFrame,
    size: int = VOCAB_SIZE,
    specials: Sequence[str] = SPECIALS,
    min_count: int = 0,
    relax: float = 1.0,
    candidates: int = 512,
    heavy: int = HEAVY_PAIRS,
    on_round=None,
) -> DataFrame:
    """A vocabulary of ``size`` pieces from word counts ``(word, n)``.

    ``relax=1`` gives exactly the one-at-a-time result, ties going to the smaller pair. Only the chosen pairs and
    the vocabulary itself, at most ``size`` pieces, reach the driver; words stay distributed. Each round's words
    and counts are written to the scratch folder and replace those of the round before. ``heavy`` is about how many
    pairs are kept counted; it changes the work, not the result.
    """
    spark = counts.sparkSession
    state = counts.select("n", packed_pieces(F.col("word")).alias("packed"), F.lit(None).cast("string").alias("before"))
    state = state.where(_OPEN)
    stage = write_stage(state.repartition(spark.sparkContext.defaultParallelism), "words")
    base = write_stage(base_pieces(counts), "alphabet").df
    room = size - len(specials)
    if base.count() > room:
        raise ValueError("size is smaller than the alphabet of the corpus")
    order = F.row_number().over(Window.orderBy("continues", "piece"))
    start = base.select((order + len(specials) - 1).alias("id"), "piece", F.lit("piece").alias("kind"))
    known = {row["piece"] for row in base.select("piece").collect()}
    first_merged = len(specials) + len(known)
    learned: list[str] = []
    triples, floor = _counted(stage.df, heavy)
    settled = set(known)  # pieces that were there when the floor was set
    while len(learned) < size - first_merged:
        least = max(min_count, floor + 1)
        best = _pairs(triples.df).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(candidates).collect()
        merges = choose_merges(best, known, size - first_merged - len(learned), relax)
        if not merges and floor < max(min_count, 1):
            break
        again = not merges or floor > 0 and any(merged_piece(a, b) in settled for a, b in merges)
        for a, b in merges:
            if merged_piece(a, b) not in known:
                known.add(merged_piece(a, b))
                learned.append(merged_piece(a, b))
        if merges:
            if on_round:
                on_round(merges)
            done, stage = stage, write_stage(_rewritten(stage.df, merges), "words")
            done.drop()
        done = triples
        if again:
            triples, floor = _counted(stage.df, heavy)
            settled = set(known)
        else:
            triples = write_stage(_summed(done.df.unionByName(_changes(stage.df))), "triples")
        done.drop()
    triples.drop()
    stage.drop()
    rows = [(first_merged + i, piece, "piece") for i, piece in enumerate(learned)]
    return (
        special_rows(spark, specials).unionByName(start).unionByName(spark.createDataFrame(rows, VOCAB_SCHEMA))
    )
