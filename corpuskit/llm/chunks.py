"""Texts as chunks that tokenizers treat alike wherever they stand, each distinct one looked up once.

A chunk begins at a text's start and at every blank (U+0020) that follows a character surely not white space, unless the
blank ends its text. Pre-tokenizers that split between a word and the blank after it, and pieces that hold no blank
behind another character, see nothing across such a place. For pre-tokenizers that also split between letters, digits and
other characters, chunks are cut between ASCII characters of different kinds; apostrophes, as in contractions, and bars,
as in the names of special tokens, are never cut off.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa

from corpuskit.llm.words import lowered, raw_bytes

T = TypeVar("T")

# Chunks that a task remembers at a time, and bytes of the longest one that it does.
REMEMBERED = 1 << 18
_REMEMBERED_BYTES = 64

# Second last bytes of the white space beyond ASCII; a few other characters share them and are taken for it.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[0xC2, 0x9A, 0x80, 0x81]] = True


def kept(name: str, key: Hashable, make: Callable[[], T]) -> T:
    """A value that this worker process holds from task to task, one for a name; another ``key`` replaces it.

    Functions are sent with their globals, so these last for one task only.
    """
    held = sys.modules.setdefault("_corpuskit_kept", types.ModuleType("_corpuskit_kept")).__dict__
    if name not in held or held[name][0] != key:
        held.pop(name, None)
        held[name] = (key, make())
    return held[name][1]


def _kinds(digit: int, space: int) -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = 1
    kinds[[0x27, 0x7C]] = 0
    kinds[0x30:0x3A] = digit
    kinds[0x41:0x5B] = kinds[0x61:0x7B] = 2
    kinds[[0x20, *range(0x09, 0x0E)]] = space
    return kinds


@dataclass(frozen=True)
class Cuts:
    """Where a tokenizer surely splits.

    ``kinds`` of bytes: 0 is never cut off, a byte of kind 9 stands alone. With ``lower`` the tokenizer lower-cases, so
    chunks are too, unless a text may hold the name of a special token.
    """

    kinds: np.ndarray
    lower: bool = False


# Byte-level words with the blank before them; lower-cased words, single digits, no white space.
BYTE_LEVEL, WORD_LEVEL = Cuts(_kinds(3, 0)), Cuts(_kinds(9, 4), lower=True)


def chunk_starts(data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """First bytes of all chunks of texts that lie end to end between ``bounds``."""
    first = np.zeros(len(data) + 2, bool)
    if len(data):
        last, blank = data[:-1], data[1:] == 0x20
        first[1:-2] = blank & (last > 0x20) & (last < 0x7F)
        wide = np.flatnonzero(blank & (last >= 0x80))
        first[wide + 1] = ~_DOUBTFUL[data[np.maximum(wide - 1, 0)]]
    first[bounds[1:] - 1] = False
    if len(data) and kinds is not None:
        kind = kinds[data]
        before, after = kind[:-1], kind[1:]
        first[1:-2] |= (before > 0) & (after > 0) & ((before != after) | (after == 9))
    first[bounds] = True
    return np.flatnonzero(first[: len(data)])


def distinct_chunks(texts: pa.Array, cuts: Cuts | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(distinct, places, bounds)``: text ``i`` is the chunks ``distinct[p]`` for ``places[bounds[i]:bounds[i + 1]]``."""
    data, offsets = raw_bytes(texts)
    data = np.ascontiguousarray(data)
    if cuts is not None and cuts.lower and b"<|" not in data.tobytes():
        data = lowered(data)
    starts = chunk_starts(data, offsets, None if cuts is None else cuts.kinds)
    edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    listed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(data)])
    coded = listed.dictionary_encode()
    raw, at = raw_bytes(coded.dictionary)
    raw, at = raw.tobytes(), at.tolist()
    distinct = [raw[a:b] for a, b in zip(at, at[1:])]
    return distinct, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, offsets)


class Memory:
    """Values of chunks, made in batches; the short ones used last are remembered, ``most`` to twice as many."""

    def __init__(self, make: Callable[[list[str]], Sequence[T]], most: int = REMEMBERED):
        self._make, self._most = make, most
        self._young: dict[bytes, T] = {}
        self._old: dict[bytes, T] = {}

    def values(self, chunks: Sequence[bytes]) -> list[T]:
        young, old = self._young, self._old
        found: list = [None] * len(chunks)
        missing = []
        for i, chunk in enumerate(chunks):
            value = young.get(chunk)
            if value is None:
                value = old.get(chunk)
                if value is None:
                    missing.append(i)
                    continue
                young[chunk] = value
            found[i] = value
        made = self._make([chunks[i].decode("utf-8", "replace") for i in missing]) if missing else []
        for i, value in zip(missing, made):
            found[i] = value
            if len(chunks[i]) <= _REMEMBERED_BYTES and len(young) < 2 * self._most:
                young[chunks[i]] = value
        if len(young) >= self._most:
            self._young, self._old = {}, young
        return found


def encoded(texts: pa.Array, memory: Memory, cuts: Cuts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each begins; ``memory`` holds little-endian 32-bit ids as bytes."""
    distinct, places, bounds = distinct_chunks(texts, cuts)
    values = memory.values(distinct)
    sizes = np.array([len(v) // 4 for v in values], np.int64)
    ids = np.frombuffer(b"".join([values[p] for p in places.tolist()]), "<u4")
    ends = np.concatenate([[0], np.cumsum(sizes[places])]) if len(places) else np.zeros(1, np.int64)
    return ids, ends[bounds]
