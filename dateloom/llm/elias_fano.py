"""Elias-Fano code of a non-decreasing sequence, with a stored select directory.

A code keeps of n values below a universe the low bits side by side and the high parts in unary: about
2 + log2(universe / n) bits a value. The directory, one 32-bit count for each STRIDE bits of the unary part, names the
block that holds the k-th value, so `select` reads one block for each value it returns and never the whole sequence.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of the unary part between counts of the directory.
STRIDE = 512
#: Values coded at once; a multiple of 8, so that the low bits of each strip fill whole bytes.
_STRIP = 1 << 16
_HEAD = "<QQIQQ"


class EliasFano:
    """n values below universe: `low` bits of each, the unary part and the counts of its set bits before each block."""

    def __init__(self, n: int, universe: int, low: int, lows: np.ndarray, highs: np.ndarray, before: np.ndarray):
        self.n, self.universe, self.low, self.lows, self.highs, self.before = n, universe, low, lows, highs, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the values decrease")
        universe = int(values[-1]) + 1 if n else 1
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        highs, lows = np.zeros((n + (universe >> low)) // 8 + 1, np.uint8), []
        for i in range(0, n, _STRIP):
            part = values[i : i + _STRIP]
            at = (part >> np.uint64(low)).astype(np.int64) + np.arange(i, i + len(part))
            np.bitwise_or.at(highs, at >> 3, (1 << (at & 7)).astype(np.uint8))
            bits = np.empty((len(part), low), np.uint8)
            for k in range(low):
                bits[:, k] = (part >> np.uint64(k)) & np.uint64(1)
            lows.append(np.packbits(bits.ravel(), bitorder="little"))
        blocks = np.add.reduceat(np.bitwise_count(highs), np.arange(0, len(highs), STRIDE // 8), dtype=np.uint32)
        before = np.concatenate(([0], np.cumsum(blocks, dtype=np.uint32))).astype("<u4")
        return cls(n, universe, low, np.concatenate([np.zeros(0, np.uint8), *lows]), highs, before)

    def __len__(self) -> int:
        return self.n

    def select(self, ks) -> np.ndarray:
        """The values at positions ks, in any order."""
        ks = np.atleast_1d(np.asarray(ks, np.int64))
        if len(ks) and (ks.min() < 0 or ks.max() >= self.n):
            raise IndexError("no such position")
        block = np.searchsorted(self.before, ks, side="right") - 1
        high = np.empty(len(ks), np.int64)
        order = np.argsort(block, kind="stable")
        # positions of one block together: its bits are laid open once
        for here in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(ks) else ():
            b = int(block[here[0]])
            ones = np.flatnonzero(np.unpackbits(self.highs[b * STRIDE // 8 : (b + 1) * STRIDE // 8], bitorder="little"))
            high[here] = b * STRIDE + ones[ks[here] - int(self.before[b])] - ks[here]
        out = high.astype(np.uint64) << np.uint64(self.low)
        for i in range(self.low):
            at = ks * self.low + i
            out |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(i)
        return out

    def dumps(self) -> bytes:
        return struct.pack(_HEAD, self.n, self.universe, self.low, len(self.lows), len(self.highs)) + self.lows.tobytes() + self.highs.tobytes() + self.before.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> EliasFano:
        """The code in data, which is read in place: nothing is decoded."""
        n, universe, low, a, b = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        return cls(n, universe, low, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data[at + a + b :], "<u4"))
