"""Elias-Fano sequences: rising integers in little more than two bits each beyond their low bits, with select."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# High bits are counted in blocks of so many bytes; the directory holds 32 bits a block.
BLOCK_BYTES = 64
_AT_ONCE = 4096
_HEADER = "<QIIQ"

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def _select_table() -> np.ndarray:
    """Place of the k-th set bit of every byte, from the lowest bit."""
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        places = [bit for bit in range(8) if byte >> bit & 1]
        table[byte, : len(places)] = places
    return table


_SELECT = _select_table()


@dataclass(frozen=True)
class EliasFano:
    """``count`` integers that never fall; fewer than 2^32 of them, each below 2^64.

    The low ``low_bits`` bits of every integer lie end to end in ``low``. Bit ``(value >> low_bits) + place`` of ``high``
    is set for every integer. ``ranks`` holds the set bits before each block of ``high``.
    """

    count: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        count = len(values)
        if count and (values[1:] < values[:-1]).any():
            raise ValueError("values fall")
        top = int(values[-1]) if count else 0
        low_bits = max(0, (top // max(count, 1)).bit_length() - 1)
        low = np.zeros(-(-count * low_bits // 64) + 1, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(count, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            # Shifted twice, as a shift by 64 is not defined.
            np.bitwise_or.at(low, word + 1, (part >> (np.uint64(63) - shift)) >> np.uint64(1))
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        blocks = (int(place[-1]) if count else 0) // (8 * BLOCK_BYTES) + 1
        bits = np.zeros(blocks * 8 * BLOCK_BYTES, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little")
        ones = _ONES[high].reshape(blocks, BLOCK_BYTES).sum(axis=1)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        return cls(count, low_bits, low.astype("<u8"), high, ranks)

    def select(self, at: np.ndarray) -> np.ndarray:
        """The integers at the places ``at``, by directory, block and byte."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.count):
            raise IndexError("no such place")
        found = np.zeros(len(at), np.uint64)
        blocks = self.high.reshape(-1, BLOCK_BYTES)
        for start in range(0, len(at), _AT_ONCE):
            part = at[start : start + _AT_ONCE]
            block = np.searchsorted(self.ranks, part, side="right") - 1
            left = part - self.ranks[block]
            ones = np.cumsum(_ONES[blocks[block]], axis=1)
            byte = (ones <= left[:, None]).sum(axis=1)
            left -= np.where(byte > 0, ones[np.arange(len(part)), np.maximum(byte - 1, 0)], 0)
            bit = (block * BLOCK_BYTES + byte) * 8 + _SELECT[blocks[block, byte], left]
            found[start : start + _AT_ONCE] = (bit - part).astype(np.uint64) << np.uint64(self.low_bits) | self._low(part)
        return found

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        first = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (first >> np.uint64(6)).astype(np.int64), first & np.uint64(63)
        both = self.low[word] >> shift | (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return both & np.uint64((1 << self.low_bits) - 1)

    def to_bytes(self) -> bytes:
        header = struct.pack(_HEADER, self.count, self.low_bits, len(self.ranks), len(self.low))
        return header + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, start: int = 0) -> tuple[EliasFano, int]:
        """A sequence written at ``start``, and where it ends."""
        count, low_bits, blocks, words = struct.unpack_from(_HEADER, data, start)
        start += struct.calcsize(_HEADER)
        low = np.frombuffer(data, "<u8", words, start)
        start += low.nbytes
        high = np.frombuffer(data, np.uint8, blocks * BLOCK_BYTES, start)
        start += high.nbytes
        ranks = np.frombuffer(data, "<u4", blocks, start)
        return cls(count, low_bits, low, high, ranks), start + ranks.nbytes
