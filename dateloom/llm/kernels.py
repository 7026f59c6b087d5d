"""Vectorised text kernels on Arrow string buffers: words, word hashes, shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte; A-Z share those of a-z, so hashes ignore ASCII case where asked.
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[65:91] = BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Whitespace of the word rule: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that one kernel call takes at most (a single longer text is one call).
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK):
    """Ranges of rows whose bytes together stay near `size`."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a block of texts: start and end byte of each, its text's number, its hash."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, fold: bool = True):
        solid = ~IS_SPACE[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begins = off[:-1][off[:-1] < len(raw)]
        first[begins] = solid[begins]
        self.start = np.flatnonzero(first)
        last = np.zeros(len(raw) + 1, bool)
        last[1:] = solid
        last[1:-1] &= ~solid[1:] | first[1:]
        self.end = np.flatnonzero(last)
        self.length = self.end - self.start
        self.bounds = np.searchsorted(self.start, off)  # of each text's words
        if len(self.start):
            pos = np.flatnonzero(solid)
            step = np.concatenate(([0], np.cumsum(self.length)[:-1]))
            within = np.arange(len(pos)) - np.repeat(step, self.length)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(self.length.max()), _STEP, np.uint64))))
                value = (BYTE_FOLDED if fold else BYTE)[raw[pos]] * power[within]
                self.hash = mix(np.add.reduceat(value, step) + self.length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, np.uint64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of all k-word windows of a run of word hashes."""
    n = len(h) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k if n > 0 else 0):
            out = mix(out * np.uint64(0xA0761D6478BD642F) + h[i : i + n])
    return out


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int):
    """For each text the sorted distinct hashes of its k-word shingles; the whole sequence as one if it has fewer words."""
    for i, j in blocks(off):
        part = off[i : j + 1] - off[i]
        w = Words(raw[off[i] : off[j]], part)
        full = windows(w.hash, k)
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
            elif b > a:
                yield windows(w.hash[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
