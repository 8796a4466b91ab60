"""Language identification by cross-parsing texts with suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.words import slices
from corpuskit.session import write_stage

# Bounds of the labelled sample the automata are built from.
SAMPLE_ROWS = 400
ROW_CHARS = 1000
SYMBOLS = 40_000
# Languages that a worker holds automata of at a time.
SHARD = 32
# Folds by crc32 of the id; the last is held out of learning.
FOLDS, HELD_OUT = 4, 2
# Texts are parsed in blocks of this many symbols, and a phrase ends with its block.
BLOCK = 1024
UNKNOWN = "und"

_SPACE, _OTHER = 1, 0


def _alphabetic() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def suffix_automaton(symbols: Sequence[int]) -> list[dict[int, int]]:
    """The smallest automaton of all substrings: per state, the state that a symbol leads to. State 0 is the start."""
    link, length, last = [-1], [0], 0
    edges: list[dict[int, int]] = [{}]
    for symbol in symbols:
        state = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in edges[at]:
            edges[at][symbol] = state
            at = link[at]
        if at != -1:
            target = edges[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                twin = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at != -1 and edges[at].get(symbol) == target:
                    edges[at][symbol] = twin
                    at = link[at]
                link[target] = link[state] = twin
        last = state
    return edges


def packed(edges: list[dict[int, int]], width: int, base: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Transitions as two flat lists ``following, owner`` and the start's number.

    A state is numbered by a place of its own from ``base`` on, and its edge by a symbol is kept that far behind it, if
    ``owner`` there is the state. Rows lie in each other's gaps, so the lists grow with the edges, not the letters.
    """
    size = 1 << max(4, (2 * sum(map(len, edges)) + len(edges)).bit_length())
    taken, used = bytearray(size + width), bytearray(size)
    numbers = [0] * len(edges)
    for state in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
        at = state * 40503 % size
        while used[at] or any(taken[at + symbol] for symbol in edges[state]):
            at = (at + 1) % size
        used[at] = 1
        for symbol in edges[state]:
            taken[at + symbol] = 1
        numbers[state] = at
    following, owner = np.zeros(size + width, np.int64), np.full(size + width, -1, np.int64)
    for at, row in zip(numbers, edges):
        for symbol, target in row.items():
            following[at + symbol] = base + numbers[target]
            owner[at + symbol] = base + at
    return following, owner, base + numbers[0]


class CrossParser:
    """Counts, per language, the phrases of a greedy parse into the longest substrings of that language's sample."""

    def __init__(self, samples: Mapping[str, Sequence[str]], symbols: int = SYMBOLS):
        self.languages = sorted(samples)
        texts = {lang: " ".join(samples[lang]).lower() for lang in self.languages}
        known = sorted({ch for text in texts.values() for ch in text if ch.isalpha()})
        # Letters of no sample match nothing; everything that is no letter is one kind of gap.
        self._class = np.where(_alphabetic(), _OTHER, _SPACE).astype(np.int32)
        self._class[[ord(ch) for ch in known]] = np.arange(len(known)) + 2
        width = len(known) + 2
        learned = [self._symbols(texts[lang])[:symbols] for lang in self.languages]
        # Place 0 is no state.
        tables, owners, base = [np.zeros(width, np.int64)], [np.full(width, -1, np.int64)], width
        self._roots = np.zeros((len(self.languages), width), np.int64)
        for number, one in enumerate(learned):
            edges = suffix_automaton(one.tolist())
            following, owner, start = packed(edges, width, base)
            for symbol in edges[0]:
                self._roots[number, symbol] = following[start - base + symbol]
            tables.append(following)
            owners.append(owner)
            base += len(following)
        kind = np.int32 if base < 1 << 31 else np.int64
        self._roots = self._roots.astype(kind)
        self._table, self._owner = np.concatenate(tables).astype(kind), np.concatenate(owners).astype(kind)
        self._bits = np.array([np.log2(max(len(x), 2)) for x in learned])

    def _symbols(self, text: str) -> np.ndarray:
        """Classes of a text's characters with runs of gaps as one."""
        classes = self._class[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] != _SPACE) | (classes[:-1] != _SPACE)
        return classes[keep]

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Phrases of every block in every language; all blocks advance by one symbol at a time."""
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        lengths = np.array([len(blocks[i]) for i in order], np.int64)
        columns = np.zeros((int(lengths[0]) if len(order) else 0, len(order)), np.int32)
        for at, i in enumerate(order):
            columns[: len(blocks[i]), at] = blocks[i]
        counts = np.zeros((len(self.languages), len(order)), np.int64)
        state = np.zeros((len(self.languages), len(order)), self._table.dtype)
        alive = len(order)
        for step, symbols in enumerate(columns):
            while alive and lengths[alive - 1] <= step:
                alive -= 1
            symbols, state = symbols[:alive], state[:, :alive]
            place = state + symbols
            following, broken = self._table[place], self._owner[place] != state
            counts[:, :alive] += broken
            state = np.where(broken, self._roots[:, symbols], following)
        back = np.empty_like(counts)
        back[:, order] = counts
        return back

    def least(self, texts: Sequence[str | None]) -> list[tuple[str, float, float] | None]:
        """Of every text the language of the least rate, that rate and the next; none without a letter."""
        blocks, owner, sizes, read = [], [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            symbols = self._symbols((text or "").lower())
            read[i] = bool((symbols != _SPACE).any())
            if read[i]:
                sizes[i] = len(symbols)
                for begin in range(0, len(symbols), BLOCK):
                    blocks.append(symbols[begin : begin + BLOCK])
                    owner.append(i)
        if not blocks:
            return [None] * len(texts)
        counts = self.phrases(blocks)
        total = np.zeros((len(self.languages), len(texts)))
        np.add.at(total, (slice(None), owner), counts)
        rate = total * self._bits[:, None] / np.maximum(sizes, 1)
        first = rate.argmin(axis=0)
        ranked = np.sort(np.vstack([rate, np.full(len(texts), np.inf)]), axis=0)
        return [
            (self.languages[k], a, b) if ok else None
            for k, a, b, ok in zip(first.tolist(), ranked[0].tolist(), ranked[1].tolist(), read.tolist())
        ]


_PARSERS: dict[int, tuple] = {}


def _parser(samples: tuple) -> CrossParser:
    """The parser of a worker process, built once from the samples."""
    key = hash(samples)
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser({lang: list(texts) for lang, texts in samples})
    return _PARSERS[key]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learned_samples(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS, shard: int = SHARD
) -> Iterator[tuple]:
    """Labelled text of every language from outside the held-out fold, ``shard`` languages at a time, by label:
    ``((lang, (text, ...)), ...)``.

    About ``sample_rows`` rows per language, drawn by a hash of id and text, with at most ``row_chars`` characters of
    each. The driver holds the labels with their counts, and the text of one shard.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    rows = rows.where((fold(F.col("id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not held:
        return
    scale = 1 << 30
    limits = [(lang, int(min(1.0, sample_rows / n) * scale), i // shard) for i, (lang, n) in enumerate(held)]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, most bigint, shard int")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(scale)).alias("draw")
    drawn = rows.join(F.broadcast(limits), "lang").select("lang", "shard", "most", draw, "id", F.substring("text", 1, row_chars).alias("text"))
    drawn = drawn.where("draw < most")
    stage = write_stage(drawn, "samples") if len(held) > shard else None
    for k in range(-(-len(held) // shard)):
        found = (stage.df.where(F.col("shard") == k) if stage else drawn).collect()
        by_lang: dict[str, list] = {}
        for row in sorted(found, key=lambda r: (r["lang"], r["draw"], r["id"], r["text"])):
            by_lang.setdefault(row["lang"], []).append(row["text"])
        if by_lang:
            yield tuple((lang, tuple(texts)) for lang, texts in by_lang.items())
    if stage:
        stage.drop()


def _rates(samples: tuple, text: Column) -> Column:
    """A struct ``(lang, rate, next)`` for a text column, null for a text without a letter."""
    kind = pa.struct([("lang", pa.string()), ("rate", pa.float64()), ("next", pa.float64())])

    @F.arrow_udf("lang string, rate double, next double")
    def parse(texts: pa.Array) -> pa.Array:
        found = []
        for part in slices(pa.record_batch([texts], ["text"])):
            found += _parser(samples).least(part.column(0).to_pylist())
        return pa.array([f and dict(zip(("lang", "rate", "next"), f)) for f in found], kind)

    return parse(text)


def _lettered(text: Column) -> Column:
    @F.arrow_udf("boolean")
    def has_letter(texts: pa.Array) -> pa.Array:
        return pa.array([any(ch.isalpha() for ch in text or "") for text in texts.to_pylist()], pa.bool_())

    return has_letter(text)


def _better(a: Column, b: Column) -> Column:
    """The least rate and the next of two shards; of equal rates the first stays."""
    second = F.struct(b["lang"].alias("lang"), b["rate"].alias("rate"), F.least(a["rate"], b["next"]).alias("next"))
    first = F.struct(a["lang"].alias("lang"), a["rate"].alias("rate"), F.least(a["next"], b["rate"]).alias("next"))
    return F.when(b["rate"] < a["rate"], second).when(a["rate"].isNotNull(), first)


def _parsed(rows: DataFrame, samples: Iterator[tuple]) -> DataFrame:
    """Rows with a ``text`` and their ``found`` beside; beyond one shard the rows are written once per shard."""
    found, before = None, None
    for shard in samples:
        if found is None:
            found = rows.withColumn("found", _rates(shard, F.col("text")))
            continue
        stage = write_stage(found, "parsed")
        if before:
            before.drop()
        before = stage
        more = stage.df.withColumn("more", _rates(shard, F.col("text")))
        found = more.withColumn("found", _better(F.col("found"), F.col("more"))).drop("more")
    return rows.withColumn("found", F.lit(None).cast("struct<lang:string,rate:double,next:double>")) if found is None else found


def identify(docs: DataFrame, **sample) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every whole text.

    The language whose sample parses the text into the fewest phrases, times the bits of a place in the sample and
    over the text's length, wins; the score is how much fewer it needs than the next, from 0 to 1. Letters are
    lower-cased and runs of anything else count as one gap. Equal languages go to the smaller label. ``und`` with
    score 0 stands for null text, text without a letter, and any text where nothing is labelled. Only ``text`` and
    non-null ``lang`` of rows outside the held-out fold are learned from; a null id is in no fold. Repeated ids are
    rows of their own; no rows give no rows. All labels are learned, ``shard`` of them at a time, and the least rate of
    all shards counts. Jobs run while the result is planned.
    """
    rows = _parsed(docs.select("doc_id", "text"), learned_samples(docs, **sample))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    score = F.coalesce(1 - F.col("found.rate") / F.col("found.next"), F.lit(0.0))
    lang = F.coalesce(F.col("found.lang"), F.lit(UNKNOWN))
    return rows.select("doc_id", held_out.alias("held_out"), lang.alias("lang_pred"), score.alias("score"))


def with_language(docs: DataFrame, **sample) -> DataFrame:
    """The documents in which a language is found, with their own columns.

    Those are the texts with a letter. One in a language that no sample holds stays, under the label of least rate; where
    nothing is labelled, all texts with a letter stay.
    """
    rows = docs.select(F.struct("*").alias("document"), F.col("text").alias("text"))
    samples = learned_samples(docs, **sample)
    first = next(samples, None)
    if first is None:
        kept = rows.where(_lettered(F.col("text")))
    else:
        kept = _parsed(rows, chain([first], samples)).where(F.col("found.lang").isNotNull())
    return kept.select(*[F.col("document")[name].alias(name) for name in docs.columns])
