"""Packing documents into fixed-length token sequences by minimum bin slack."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskit.llm.chunks import BYTE_LEVEL, Memory, encoded
from corpuskit.llm.words import slices
from corpuskit.session import write_stage

LENGTH = 2048
END_ID = 0
# Pieces packed together by one task.
GROUP_PIECES = 4096
# Chunks that a task remembers the ids of.
REMEMBERED = 1 << 17

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Latin text, for which both libraries split alike, in words no longer than the faster one merges well.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_LONG_RUN = re.compile(r"[^\s]{400}|\s{400}")

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, slot bigint"
_PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit integers, by ``tokenizers`` without special tokens.

    ``vocabulary`` is read by ``tokenizers`` and settles the ids; strings of its added tokens in a text are those tokens.
    ``ranks`` is the same vocabulary for ``tiktoken``, which gives the same ids several times faster; it is used for Latin
    text without added tokens and very long runs.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str | None = RANKS):
        self._vocabulary, self._slow, self._fast = vocabulary, None, None
        with open(vocabulary, encoding="utf-8") as file:
            self._added = [token["content"] for token in json.load(file)["added_tokens"]]
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding(
                "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def ids(self, text: str) -> np.ndarray:
        plain = self._fast is not None and _PLAIN.fullmatch(text) and not _LONG_RUN.search(text)
        if plain and not any(token in text for token in self._added):
            return np.array(self._fast.encode_ordinary(text), "<u4")
        if self._slow is None:
            self._slow = Tokenizer.from_file(self._vocabulary)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4")

    def memory(self) -> Memory:
        """Ids of chunks of texts as bytes; see ``chunks``."""
        return Memory(lambda chunks: [self.ids(chunk).tobytes() for chunk in chunks], REMEMBERED)


def cut_points(total: int, length: int) -> list[int]:
    """Starts of the pieces of ``total`` ids, and their end: all pieces are full but perhaps the first."""
    first = total % length or min(total, length)
    return [0, *range(first, total + 1, length)]


def pieces(
    docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, ranks: str | None = RANKS
) -> DataFrame:
    """Documents as token pieces ``(doc_id, piece, start, length, ids, slot)``.

    A document is the ids of its whole text, then the id 0; null text is empty. Documents of more than ``length`` ids
    are cut into full pieces, the first of which may be shorter. ``ids`` holds little-endian unsigned 32-bit
    integers; ``slot`` numbers the pieces of a task.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, closing = Encoder(vocabulary, ranks).memory(), np.array([END_ID], "<u4")
        slot = TaskContext.get().partitionId() << 40
        for part in (x for batch in batches for x in slices(batch)):
            rows = []
            every, bounds = encoded(part.column(1), memory, BYTE_LEVEL)
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                ids = np.concatenate([every[bounds[i] : bounds[i + 1]], closing])
                points = cut_points(len(ids), length)
                for piece, (begin, end) in enumerate(zip(points, points[1:])):
                    rows.append((doc_id, piece, begin, end - begin, ids[begin:end].tobytes(), slot))
                    slot += 1
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids", "slot"]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, _PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, largest first among the open ones, whose sum comes nearest to ``room`` without passing it.

    The bits of an integer are the sums that can be reached; lengths are added until the room itself is one of them.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reached | reached << length) & mask
            if more == reached:
                break
            steps.append((length, reached))
            reached = more
        if reached >> room & 1:
            break
    left, chosen = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return chosen


def bins(lengths: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Minimum bin slack: ``(lengths of a bin, how many such bins)`` until all lengths are used.

    Every bin holds the largest length left and the combination of others that fills it most; a combination is
    repeated while its lengths last.
    """
    values, held = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), held.tolist()))
    made = []
    while counts:
        largest = max(counts)
        others = dict(counts)
        others[largest] -= 1
        if not others[largest]:
            del others[largest]
        chosen = [largest, *fullest(others, capacity - largest)]
        need = {x: chosen.count(x) for x in chosen}
        times = min(counts[x] // n for x, n in need.items())
        made.append((chosen, times))
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return made


def _pack(key, group: pa.Table, capacity: int) -> pa.Table:
    group = group.sort_by([("length", "ascending"), ("slot", "ascending")])
    lengths = group["length"].to_numpy()
    values, first = np.unique(lengths, return_index=True)
    following = dict(zip(values.tolist(), first.tolist()))
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = key[0].as_py() << 32
    for chosen, times in bins(lengths, capacity):
        for _ in range(times):
            place = 0
            for length in chosen:
                row = following[length]
                following[length] = row + 1
                sequence[row], offset[row] = number, place
                place += length
            number += 1
    kept = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def place(cut: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32, slot)``, written before, with ``sequence_id, offset``.

    Pieces are dealt evenly over groups by their slot and each group is packed by itself: at most one sequence per
    group is less than full for want of pieces.
    """
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    return dealt.groupBy("pack").applyInArrow(lambda key, group: _pack(key, group, length), _PLACED)


def pack_documents(
    docs: DataFrame,
    length: int = LENGTH,
    group_pieces: int = GROUP_PIECES,
    vocabulary: str = VOCABULARY,
    ranks: str | None = RANKS,
) -> DataFrame:
    """Where every piece of every document lies: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    ``ids_crc32`` is the checksum of the piece's ids as ``pieces`` gives them. Null and empty texts are one piece of
    one id; a null id stays null; rows that repeat an id are packed as documents of their own; no rows give no rows;
    columns other than ``doc_id`` and ``text`` are ignored. Jobs run while the result is planned.
    """
    cut = pieces(docs, length, vocabulary, ranks)
    measured = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "slot")
    return place(write_stage(measured, "pieces").df, length, group_pieces)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, doc_ids, ids)`` with the ids of all pieces end to end."""
    cut = write_stage(pieces(docs, length, vocabulary, ranks), "pieces").df
    placed = place(cut.withColumn("ids_crc32", F.col("slot")).drop("ids"), length)
    joined = placed.join(cut.select("slot", "ids"), placed["ids_crc32"] == cut["slot"])
    entry = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return joined.groupBy("sequence_id").agg(entry.alias("held")).select(
        "sequence_id",
        F.col("held.doc_id").alias("doc_ids"),
        F.aggregate("held.ids", F.lit(b""), lambda s, x: F.concat(s, x)).alias("ids"),
    )
