"""Two tokenizations of the same texts aligned by bytes, and how often their ids meet in the whole corpus.

Byte-level BPE gives spans of characters, the piece model spans of bytes. Both are cuts of the text; where several tokens
share a character, or a span does not cover a token's bytes, the token's end follows from its decoded bytes. Ends common to
both cut the tokens into groups, and within a group tokens are linked where their bytes overlap.

Texts are aligned by chunks: neither tokenizer looks across a blank after a character that is not white space, as pieces
hold blanks in front only. A text with a chunk whose bytes are not given back is aligned whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpuskit.llm.chunks import Memory, distinct_chunks, kept
from corpuskit.llm.words import raw_bytes, slices
from corpuskit.session import write_stage

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Pairs of ids whose counts are broadcast, the commonest; the counts of others are joined.
HOT_PAIRS = 1 << 18
# Chunks that a task remembers, characters of chunks tokenized at once, and pairs counted before they are handed on.
REMEMBERED = 1 << 18
_JOINED_CHARS = 1 << 16
_HELD_PAIRS = 1 << 19

_TOKENIZED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, pair bigint, n bigint"
)
_TOKENIZED_ARROW = pa.schema(
    [
        (name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind])
        for name, kind in (column.split() for column in _TOKENIZED.split(", "))
    ]
)
_LINKED = "row bigint, n_links bigint, n_best bigint, count_sum bigint, rest array<struct<pair: bigint, n: bigint>>"


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for every byte: itself where it is printable Latin-1, else the
    next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def token_ends(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the tokens' bytes end: with their spans where these hold as many bytes, else behind their decoded bytes."""
    return np.where(ends - starts == sizes, ends, np.cumsum(sizes))


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(places in a, places in b, where each link ends, whether both tokens end there)``.

    Between two neighbouring ends of any side lie the bytes that one token of each side share.
    """
    ends = np.union1d(a_ends, b_ends)
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return i, j, ends, (a_ends[i] == ends) & (b_ends[j] == ends)


class Aligned(NamedTuple):
    """A chunk's tokens of both sides, groups, links as pairs of ids, and groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    links: bytes
    shown: str


NOTHING = Aligned(0, 0, 0, b"", "")


class Aligner:
    """Aligns texts that begin with a blank; special tokens written in them are plain text."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._first = Tokenizer.from_file(byte_level)
        self._first.encode_special_tokens = True
        letters = byte_alphabet()
        entries = [self._first.id_to_token(i) or "" for i in range(self._first.get_vocab_size())]
        self.first_bytes = [bytes(letters[c] for c in entry if c in letters) for entry in entries]
        self._second = SentencePieceProcessor(model_file=pieces)
        self.second_bytes, self.separable = [], True
        for i in range(self._second.get_piece_size()):
            piece = self._second.id_to_piece(i)
            if self._second.is_byte(i):
                self.second_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.separable &= "▁" not in piece.lstrip("▁")
                self.second_bytes.append(piece.replace("▁", " ").encode())
        self._first_sizes, self._second_sizes = (np.array([len(x) for x in side]) for side in (self.first_bytes, self.second_bytes))
        self.kind = np.dtype("<u2" if max(len(self.first_bytes), len(self.second_bytes)) <= 1 << 16 else "<u4")

    def _sides(self, text: str, raw: bytes):
        """Ids and ends of both sides, or None where the bytes of a side differ from the text's."""
        one = self._first.encode(text, add_special_tokens=False)
        a = np.array(one.ids, np.int64)
        # The model puts the blank in front itself.
        pieces = [(p.id, p.begin, p.end) for p in self._second.encode(text[1:], return_type="proto").pieces]
        b, starts, ends = np.array(pieces, np.int64).reshape(-1, 3).T
        if b"".join([self.first_bytes[i] for i in a.tolist()]) != raw or b"".join([self.second_bytes[i] for i in b.tolist()]) != raw:
            return None
        spans = np.array(one.offsets, np.int64).reshape(-1, 2)
        if len(raw) != len(text):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            spans = np.concatenate([[0], np.cumsum(sizes)])[spans]
        starts = starts + 1
        starts[:1] = 0
        return a, token_ends(*spans.T, self._first_sizes[a]), b, token_ends(starts, ends + 1, self._second_sizes[b])

    def _align(self, chunks: Sequence[str]) -> list[Aligned] | None:
        """Chunks as one text, or None where its bytes are not given back."""
        text = "".join(chunks)
        raw = text.encode()
        sides = self._sides(text, raw)
        if sides is None:
            return None
        a, a_ends, b, b_ends = sides
        sizes = [len(c) for c in chunks] if len(raw) == len(text) else [len(c.encode()) for c in chunks]
        chunk_ends = np.cumsum(sizes)
        i, j, ends, common = links_of(a_ends, b_ends)
        links = np.stack([a[i], b[j]], axis=1).astype(self.kind)
        link_at = np.concatenate([[0], np.searchsorted(ends, chunk_ends, side="right")]).tolist()
        a_at = np.concatenate([[0], np.searchsorted(a_ends, chunk_ends, side="right")]).tolist()
        b_at = np.concatenate([[0], np.searchsorted(b_ends, chunk_ends, side="right")]).tolist()
        last = np.flatnonzero(common)
        group_at = np.concatenate([[0], np.searchsorted(ends[last], chunk_ends, side="right")]).tolist()
        shown_a, shown_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_cut, b_cut = [0, *(i[last] + 1).tolist()], [0, *(j[last] + 1).tolist()]
        groups = [
            f"{','.join(shown_a[k:m])}|{','.join(shown_b[n:o])}" if m - k + o - n > 2 else f"{shown_a[k]}|{shown_b[n]}"
            for k, m, n, o in zip(a_cut, a_cut[1:], b_cut, b_cut[1:])
        ]
        return [
            Aligned(
                a_at[c + 1] - a_at[c],
                b_at[c + 1] - b_at[c],
                group_at[c + 1] - group_at[c],
                links[link_at[c] : link_at[c + 1]].tobytes(),
                ";".join(groups[group_at[c] : group_at[c + 1]]),
            )
            for c in range(len(chunks))
        ]

    def values(self, chunks: Sequence[str]) -> list[Aligned | bool]:
        """Every chunk's alignment, or False where the bytes of a side differ from its own.

        Chunks are tokenized many at a time, end to end; those that end in white space alone.
        """
        found: list = [False] * len(chunks)
        joined, alone = [], []
        for n, chunk in enumerate(chunks):
            (joined if self.separable and not chunk[-1].isspace() else alone).append(n)
        batches, size = [[n] for n in alone], _JOINED_CHARS
        for n in joined:
            if size >= _JOINED_CHARS:
                batches.append([])
                size = 0
            batches[-1].append(n)
            size += len(chunks[n])
        while batches:
            batch = batches.pop()
            made = self._align([chunks[n] for n in batch])
            if made is not None:
                for n, value in zip(batch, made):
                    found[n] = value
            elif len(batch) > 1:
                half = len(batch) // 2
                batches += [batch[:half], batch[half:]]
        return found


class _Slices:
    """Texts of Arrow batches as chunks with their values; texts that are aligned whole are chunks of their own."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self._memory = Memory(aligner.values, REMEMBERED)

    def __call__(self, texts: pa.Array) -> tuple[list[Aligned], np.ndarray, np.ndarray]:
        """``(values, places, bounds)``: text ``i`` has the values at ``places[bounds[i]:bounds[i + 1]]``, none where
        it has no tokens."""
        filled = texts.fill_null("")
        led = pc.binary_join_element_wise(pa.scalar(" ", filled.type), filled, pa.scalar("", filled.type))
        if self.aligner.separable:
            distinct, places, bounds = distinct_chunks(led)
        else:
            distinct = [t.encode() for t in led.to_pylist()]
            places, bounds = np.arange(len(distinct)), np.arange(len(distinct) + 1)
        values = self._memory.values(distinct)
        lost = np.array([v is False for v in values], bool)
        empty = pc.equal(pc.binary_length(filled), 0).to_numpy(zero_copy_only=False)
        broken = np.add.reduceat(lost[places].astype(np.int64), bounds[:-1]) > 0 if len(places) else empty.copy()
        if not (broken | empty).any():
            return values, places, bounds
        parts = []
        for i in range(len(texts)):
            part = places[bounds[i] : bounds[i + 1]]
            if empty[i]:
                part = part[:0]
            elif broken[i]:
                one = self.aligner.values([led[i].as_py()])[0] if len(part) > 1 else False
                part = np.array([len(values)] if one else [], np.int64)
                values = [*values, one] if one else values
            parts.append(part)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return [v or NOTHING for v in values], np.concatenate(parts).astype(np.int64), bounds


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.add.reduceat(counts, first)


def _pairs(links: bytes, kind: np.dtype) -> np.ndarray:
    both = np.frombuffer(links, kind).reshape(-1, 2).astype(np.int64)
    return both[:, 0] << 32 | both[:, 1]


def _tokenized(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    """A row for every text, and rows with the counts of the task's pairs."""
    read = kept("alignment", (byte_level, pieces), lambda: _Slices(Aligner(byte_level, pieces)))
    aligner = read.aligner
    held, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    row = TaskContext.get().partitionId() << 40

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        made = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _TOKENIZED_ARROW]
        return pa.record_batch(made, schema=_TOKENIZED_ARROW)

    def settle() -> None:
        nonlocal held, counts, waiting
        every = np.concatenate([held, *(p for p, _ in waiting)])
        if len(every):
            held, counts = _summed(every, np.concatenate([counts, *(n for _, n in waiting)]))
        waiting = []

    for part in (x for batch in batches for x in slices(batch)):
        values, places, bounds = read(part.column(1))
        times = np.bincount(places, minlength=len(values))
        used = np.flatnonzero(times)
        sizes = np.array([len(values[p].links) for p in used], np.int64) // (2 * aligner.kind.itemsize)
        waiting.append((_pairs(b"".join([values[p].links for p in used]), aligner.kind), np.repeat(times[used], sizes)))
        if sum(len(p) for p, _ in waiting) > _HELD_PAIRS:
            settle()
            if len(held) > _HELD_PAIRS:
                yield rows(pair=held, n=counts)
                held, counts = held[:0], counts[:0]
        sums = np.array([v[:3] for v in values], np.int64).reshape(-1, 3)
        totals = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(sums[places], axis=0)])
        totals = totals[bounds[1:]] - totals[bounds[:-1]]
        digests, links = [], []
        for begin, end in zip(bounds.tolist(), bounds[1:].tolist()):
            mine = [values[p] for p in places[begin:end].tolist()]
            shown = ";".join([v.shown for v in mine])
            digests.append(hashlib.sha256(shown.encode()).hexdigest() if mine else "")
            links.append(b"".join([v.links for v in mine]))
        yield rows(
            row=np.arange(row, row + len(digests)),
            doc_id=part.column(0),
            n_a=totals[:, 0],
            n_b=totals[:, 1],
            n_groups=totals[:, 2],
            groups_sha256=digests,
            links=links,
        )
        row += len(digests)
    settle()
    yield rows(pair=held, n=counts)


def _hot(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, their counts, and whether they are best: about the ``most`` commonest, never more."""
    step = F.floor(F.log2("n") * 8).alias("step")
    kept, floor = 0, None
    for row in counted.groupBy(step).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        if kept + row["pairs"] > most:  # eight rows per doubling of the count
            break
        kept, floor = kept + row["pairs"], row["least"]
    if floor is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    found = counted.where(F.col("n") >= floor).toArrow()
    pairs, n, best = (found[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return pairs[order], n[order], best[order].astype(bool)


def _counted(batches: Iterator[pa.RecordBatch], hot: tuple, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """For every text its links, those of hot pairs counted, and the other pairs with how often it has them."""
    known, known_counts, known_best = hot
    for part in (x for batch in batches for x in slices(batch, "links")):
        raw, offsets = raw_bytes(part.column(1))
        coded = pa.array(_pairs(raw.tobytes(), kind)).dictionary_encode()
        pairs, places = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        bounds = offsets // (2 * kind.itemsize)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
        hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
        best, sums = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        best[hit], sums[hit] = known_best[at[hit]], known_counts[at[hit]]
        totals = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([best, sums], axis=1)[places], axis=0)])
        totals = totals[bounds[1:]] - totals[bounds[:-1]]
        other = np.flatnonzero(~hit[places])
        order = np.lexsort((places[other], owner[other]))
        mine, rest = owner[other][order], places[other][order]
        new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (rest[1:] != rest[:-1])])) if len(rest) else rest
        times = np.diff(np.append(new, len(rest)))
        values = pa.StructArray.from_arrays([pa.array(pairs[rest[new]]), pa.array(times)], ["pair", "n"])
        starts = np.searchsorted(mine[new], np.arange(len(bounds))).astype(np.int32)
        yield pa.record_batch(
            [
                part.column(0),
                pa.array(np.diff(bounds)),
                pa.array(totals[:, 0]),
                pa.array(totals[:, 1]),
                pa.ListArray.from_arrays(pa.array(starts), values),
            ],
            ["row", "n_links", "n_best", "count_sum", "rest"],
        )


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Both tokenizations of every whole text against each other: ``(doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256)``.

    A text with a blank in front is tokenized by both vocabularies. ``n_links`` are the pairs of tokens whose bytes
    overlap; the count of a pair of ids is in how many links of all texts it stands. ``n_best`` are the links with the
    largest count of their second id, ``count_sum`` adds up the counts of all links. Groups are the tokens between ends
    common to both, written ``a1,a2|b1;a3|b2``.

    Null and empty texts, and those whose bytes a side does not give back, have zeros and an empty checksum. Rows that
    repeat an id are documents of their own; a null id stays null; no rows give no rows; other columns are ignored. The
    counts of the commonest ``hot_pairs`` pairs go to all tasks, those of others are joined, each of them at most about
    1 / ``hot_pairs`` of all links. Jobs run while the result is planned.
    """
    spark = docs.sparkSession
    kind = Aligner(byte_level, pieces).kind
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    every = write_stage(texts.mapInArrow(lambda batches: _tokenized(batches, byte_level, pieces), _TOKENIZED), "tokenized").df
    counted = every.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = write_stage(counted, "pairs").df
    second = F.col("pair").bitwiseAND((1 << 32) - 1)
    # As many rows as the second vocabulary has ids.
    tops = counted.groupBy(second.alias("second")).agg(F.max("n").alias("top"))
    counted = counted.join(F.broadcast(tops), second == F.col("second")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    counted = write_stage(counted, "counts").df
    shared = spark.sparkContext.broadcast(_hot(counted, hot_pairs))

    tokenized = every.where("row IS NOT NULL")
    linked = tokenized.select("row", "links").mapInArrow(lambda batches: _counted(batches, shared.value, kind), _LINKED)
    linked = write_stage(linked, "linked").df
    single = linked.select("row", F.explode("rest").alias("link")).select("row", "link.pair", F.col("link.n").alias("times"))
    more = single.join(counted, "pair").select(
        "row", (F.col("times") * F.col("best").cast("bigint")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    sums = linked.select("row", "n_links", "n_best", "count_sum").unionByName(more.withColumn("n_links", F.lit(0).cast("bigint")))
    sums = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    return tokenized.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
