"""Words, lines and hashes of whole texts, by numpy over the UTF-8 bytes of Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+``. None of those bytes occurs inside a longer UTF-8 sequence, so spans of bytes
are spans of text. Hashes have 64 bits; where equal ones must be equal words, the words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 18

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    """mixed() of one value."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


with np.errstate(over="ignore"):
    BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def multipliers(begin: int, end: int) -> np.ndarray:
    """A multiplier for each place, drawn as if at random, so that no pattern of bytes makes sums of products meet as it does with powers of a base."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(begin, end, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


#: Bytes hashed at once, and the multipliers of the first places.
AT_ONCE = 1 << 20
FIRST = multipliers(0, 1 << 12)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of data, none of them empty: the sum of each byte's value times its place's multiplier, and the length, mixed."""
    size = ends - starts
    out = np.zeros(len(size), np.uint64)
    stop, lo = np.cumsum(size), 0
    with np.errstate(over="ignore"):
        while lo < len(size):
            before = int(stop[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(stop, before + AT_ONCE, "right")))
            if size[lo] > AT_ONCE:
                for a in range(0, int(size[lo]), AT_ONCE):
                    b = min(a + AT_ONCE, int(size[lo]))
                    out[lo] += (BYTE_VALUE[data[starts[lo] + a : starts[lo] + b]] * multipliers(a, b)).sum()
            else:
                n, end = size[lo:hi], stop[lo:hi] - before
                place = np.arange(end[-1]) - np.repeat(end - n, n)
                most = int(n.max())
                by = FIRST if most <= len(FIRST) else multipliers(0, most)
                out[lo:hi] = np.add.reduceat(BYTE_VALUE[data[place + np.repeat(starts[lo:hi], n)]] * by[place], end - n)
            lo = hi
        return mixed(out + size.astype(np.uint64))


@dataclass
class Texts:
    """Some texts: their bytes one after the other, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        n, at = len(self.data), self.offsets
        is_word = ~IS_SEPARATOR[self.data]
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        before[at[at < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        after[at[at > 0] - 1] = False
        self.starts = np.flatnonzero(is_word & ~before)
        self.ends = np.flatnonzero(is_word & ~after) + 1
        self.is_word = is_word
        #: The words of text i are numbers first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, at)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        return hashed(self.data, starts, ends)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word: a hash of it and the k - 1 next, and whether these are all words of its text."""
        n = len(hashes)
        full = np.zeros(n, bool)
        last = np.repeat(self.first[1:], self.n_words)
        full[:] = np.arange(n) + k <= last
        out, by = np.zeros(n, np.uint64), multipliers(0, k)
        with np.errstate(over="ignore"):
            for j in range(min(k, n)):
                out[: n - j] += hashes[j:] * by[j]
            return mixed(out), full

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums, for each text, of one value for each word."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def bytes_per_text(self, of: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the property."""
        sums = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def texts(column: pa.Array, lower: bool = False) -> Iterator[Texts]:
    """The column's texts in order, null as empty, about CHUNK bytes at a time."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        part = data[at[lo] : at[hi]]
        yield Texts(LOWER[part] if lower else part, at[lo : hi + 1] - at[lo])
        lo = hi
