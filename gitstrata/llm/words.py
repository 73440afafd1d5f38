"""Whole-column word work for tasks that take texts as Arrow batches.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and
carriage return; UTF-8 never uses these bytes inside a character, so working on bytes
is exact. NULL counts as the empty text. A batch is worked off in slices of whole texts
of about ``SLICE`` bytes, so a task holds a few arrays of that length at a time.

Fingerprints are 64-bit polynomial (Rabin-Karp) hashes modulo 2**64 over random values
per byte or word, followed by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE, _WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length() if size <= SLICE * 2 else n
        known = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            known.append(np.cumprod(p, dtype=np.uint64))
        known = tuple(known)
        if size <= SLICE * 2:
            _powers[base] = known
    return known[0][:n], known[1][:n]


def rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ``values[i] * base**i`` and the inverse powers that align two of them."""
    power, inverse = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return sums, inverse


@dataclass
class Texts:
    """Some whole texts: their bytes end to end, and where each begins."""

    data: np.ndarray
    bounds: np.ndarray
    row: int

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte start and end of every word."""
        full = ~BLANK[self.data]
        n = len(full)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = full[:-1], full[1:]
        cut = self.bounds[:-1]
        before[cut[cut < n]] = False
        cut = self.bounds[1:] - 1
        after[cut[cut >= 0]] = False
        return np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1

    @cached_property
    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.spans[0], self.bounds)

    @cached_property
    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def prints(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of byte ranges."""
        sums, inverse = rolling(BYTE_VALUE[self.data], _BYTE_BASE)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)

    @cached_property
    def words(self) -> np.ndarray:
        """Fingerprint of every word."""
        return self.prints(*self.spans)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words of one text, in order."""
        total = len(self.words)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums, inverse = rolling(self.words, _WORD_BASE)
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return at, mix((sums[at + n] - sums[at]) * inverse[at])

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """Per text, how many bytes have a true entry in ``table``."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(table[self.data], out=sums[1:])
        return np.diff(sums[self.bounds])


def slices(column: pa.Array, lower: bool = False, size: int = SLICE) -> Iterator[Texts]:
    """The texts of a column in slices; ``row`` is the first text's place in the column."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        yield Texts(LOWER[part] if lower else part, offsets[row : end + 1] - offsets[row], row)
        row = end


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """``values`` cut into consecutive lists of ``counts`` items."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
