"""Words of text columns as 64-bit hashes, on whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# A word is a run of bytes other than these six.
_BREAKS = np.zeros(256, bool)
_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
# Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x += _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


@dataclass(frozen=True)
class Words:
    """The words of consecutive texts: ``bounds[i]:bounds[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def bytes(self, i: int, keep: np.ndarray | None = None) -> list[bytes]:
        """The words of text ``i``, or those that ``keep`` marks."""
        lo, hi = self.bounds[i], self.bounds[i + 1]
        pick = np.arange(lo, hi) if keep is None else lo + np.flatnonzero(keep)
        raw = self.data.tobytes() if len(self) == 1 else self.data
        if isinstance(raw, bytes):
            return [raw[a:b] for a, b in zip(self.starts[pick].tolist(), self.ends[pick].tolist())]
        return [raw[a:b].tobytes() for a, b in zip(self.starts[pick].tolist(), self.ends[pick].tolist())]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of every text in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split(texts: pa.Array, fold: bool = False, breaks: np.ndarray = _BREAKS) -> Words:
    """Words with their hashes; ``fold`` lower-cases A-Z first, ``breaks`` marks the bytes between words."""
    data, offsets = raw_bytes(texts)
    if fold:
        data = _LOWER[data]
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts):
        lengths = ends - starts
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        powers = np.ones(int(lengths.max()), np.uint64)
        np.multiply.accumulate(np.full(len(powers) - 1, _BASES[0]), out=powers[1:])
        parts = _BYTES[data[inside]] * powers[place]
        hashes = mix(np.add.reduceat(parts, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of every ``width`` consecutive words, by doubling; the result has ``len - width + 1`` entries."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    base = int(_BASES[salt])
    power = hashes if salt == 0 else mix(hashes ^ np.uint64(salt))
    done, reach, span = None, 0, 1
    rest = width
    while rest:
        if rest & 1:
            if done is None:
                done, reach = power, span
            else:
                n = len(hashes) - reach - span + 1
                done = done[:n] * np.uint64(pow(base, span, 1 << 64)) + power[reach : reach + n]
                reach += span
        rest >>= 1
        if rest:
            power = power[:-span] * np.uint64(pow(base, span, 1 << 64)) + power[span:]
            span *= 2
    return mix(done)


def window_mask(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the ``total - width + 1`` windows lie within one text."""
    if total < width:
        return np.zeros(0, bool)
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(total - width + 1) + width <= end[: total - width + 1]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most ``limit`` bytes together, or one text."""
    texts = batch.column(batch.schema.get_field_index(column))
    lengths = raw_bytes(texts)[1]
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(lengths, lengths[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield batch.slice(begin, end - begin)
        begin = end
