"""Words and word-window hashes of whole Arrow string columns, without a Python loop over words.

All functions work on one Arrow batch.  A word is a run of bytes that ``WordRule.keep`` accepts; runs never
cross a row.  Words and windows get 64-bit polynomial hashes taken from prefix sums modulo 2**64, so a window of
any length costs the same.  Two different windows share a hash with probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, and 5 modulo 8: its powers have the longest period
_STEP = 0xD1342543DE82EF95


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd number and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                steps = np.full(size, b, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


@dataclass(frozen=True)
class WordRule:
    """Which bytes of the UTF-8 text belong to words, and whether A-Z count as a-z."""

    keep: bytes  # 256 flags
    fold: bool

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        values = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
        if self.fold:
            values[65:91] = values[97:123]
        return np.frombuffer(self.keep, np.uint8).astype(bool), values


def _flags(out: list[tuple[int, int]]) -> bytes:
    return bytes(0 if any(a <= b <= z for a, z in out) else 1 for b in range(256))


#: ``[^\x20\x09-\x0D]+``
SPACED = WordRule(_flags([(0x20, 0x20), (0x09, 0x0D)]), fold=False)
SPACED_LOWER = WordRule(SPACED.keep, fold=True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, so A-Z belong to words too
ALNUM_LOWER = WordRule(_flags([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]), fold=True)


@dataclass
class Words:
    """The words of n rows.  ``first[i]:first[i + 1]`` are the words of row i."""

    data: np.ndarray  # bytes of all rows
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each window of k consecutive words of one row."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        up, down = _WORD_POWERS.take(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(self.hashes * up[:n], out=total[1:])
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)  # words of the row from here on
        at = np.flatnonzero(left >= k)
        return at, mix((total[at + k] - total[at]) * down[at] + U64(k))

    def whole(self) -> np.ndarray:
        """One hash for the word sequence of each row."""
        n = len(self.hashes)
        up, down = _WORD_POWERS.take(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(self.hashes * up[:n], out=total[1:])
        a, b = self.first[:-1], self.first[1:]
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def find_words(col: pa.Array, rule: WordRule) -> Words:
    data, off = buffers(col)
    keep, values = rule.tables()
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = keep[data]
    starts, ends = inside[:n].copy(), inside[:n].copy()
    starts[1:] &= ~inside[: n - 1] if n else starts[1:]
    ends &= ~inside[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]  # rows that begin within the bytes: a word ends before, one may start here
    starts[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _BYTE_POWERS.take(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(values[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    return Words(data, start, end, np.searchsorted(start, off), hashes)


def pieces(batch: pa.RecordBatch, column: str, limit: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows whose texts have about ``limit`` bytes; one long text is its own slice."""
    sizes = np.diff(buffers(batch.column(column))[1])
    total, begin = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (total + size > limit or i - begin == rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
