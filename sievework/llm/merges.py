"""Byte-pair merges of many words at once, in numpy.

Every word has an agenda of its adjacent pairs that merge; the pair of lowest rank, the leftmost of equals, is taken
from it first, as the tokenizer libraries do. Each round takes one candidate from the agenda of every word that has
any. A word of more than LONG symbols has its agenda in a heap, and is worked out alone, in time n log n.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

NONE = np.int64(1 << 40)
#: Symbols of a word beyond which a heap is its agenda; bytes of words compared at once.
LONG, AT_ONCE = 256, 1 << 20


class Table:
    """A set of 64-bit keys that are not 2**64 - 1: open addressing, many keys at a time."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, most: int) -> None:
        self.bits = max(10, (4 * most).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; that of an absent key is free."""
        slot, mask = self._first(keys), len(self.keys) - 1
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != self.EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            there = self.keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there != self.EMPTY)]
        return slot

    def put(self, keys: np.ndarray) -> np.ndarray:
        """Adds distinct absent keys, and gives their slots."""
        slot, mask, todo = self._first(keys), len(self.keys) - 1, np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == self.EMPTY]
            one, at = np.unique(slot[free], return_index=True)
            self.keys[one] = keys[free[at]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        return slot

    def _first(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)


class Memo:
    """Ids of words by 64-bit keys, for a bounded number of words, bytes and ids: when one is reached, all are forgotten.

    Words are kept beside their ids, and a word found by its key is compared; one that differs is worked out by itself.
    """

    def __init__(self, most_keys: int = 200_000, most_ids: int = 2_000_000, most_bytes: int = 8_000_000) -> None:
        self.most_keys, self.most_ids, self.most_bytes = most_keys, most_ids, most_bytes
        self._forget(most_keys)

    def _forget(self, room: int) -> None:
        self.table = Table(room)
        self.begin, self.size, self.at, self.length = (np.zeros(len(self.table.keys), np.int64) for _ in "abcd")
        self.pool, self.n_ids, self.n_keys = np.zeros(1 << 16, np.uint32), 0, 0
        self.words, self.n_bytes = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _room(pool: np.ndarray, n: int) -> np.ndarray:
        while n > len(pool):
            pool = np.concatenate([pool, np.zeros_like(pool)])
        return pool

    def get(
        self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, work_out: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (spans of data, with their keys), one after the other, and how many each has.

        work_out gets the places of some words that are not known, and gives their ids and how many each has.
        """
        length = ends - starts
        slot = self.table.find(keys)
        new = np.flatnonzero(self.table.keys[slot] != keys)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            if self.n_keys + len(new) > self.most_keys or self.n_ids > self.most_ids or self.n_bytes > self.most_bytes:
                new = np.unique(keys, return_index=True)[1]
                self._forget(max(self.most_keys, len(new)))
            flat, n = work_out(new)
            self.pool = self._room(self.pool, self.n_ids + len(flat))
            self.pool[self.n_ids : self.n_ids + len(flat)] = flat
            spelled = data[spans(starts[new], length[new])]
            self.words = self._room(self.words, self.n_bytes + len(spelled))
            self.words[self.n_bytes : self.n_bytes + len(spelled)] = spelled
            slot = self.table.put(keys[new])
            self.begin[slot], self.size[slot] = self.n_ids + np.cumsum(n) - n, n
            self.at[slot], self.length[slot] = self.n_bytes + np.cumsum(length[new]) - length[new], length[new]
            self.n_ids += len(flat)
            self.n_bytes += len(spelled)
            self.n_keys += len(new)
            slot = self.table.find(keys)
        begin, n, flat = self.begin[slot], self.size[slot], self.pool
        other = self._others(slot, data, starts, length)
        if len(other):
            own, n_own = work_out(other)
            flat = np.concatenate([self.pool[: self.n_ids], own.astype(np.uint32)])
            n = n.copy()
            begin[other], n[other] = self.n_ids + np.cumsum(n_own) - n_own, n_own
        return flat[spans(begin, n)], n

    def _others(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The places of words that are not those which their keys stand for."""
        other = self.length[slot] != length
        same = np.flatnonzero(~other)
        stop, lo = np.cumsum(length[same]), 0
        while lo < len(same):
            before = int(stop[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(stop, before + AT_ONCE, "right")))
            some = same[lo:hi]
            n = length[some]
            differ = self.words[spans(self.at[slot[some]], n)] != data[spans(starts[some], n)]
            if differ.any():
                other[np.repeat(some, n)[differ]] = True
            lo = hi
        return np.flatnonzero(other)


def spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, n of each, one span after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Pairs:
    """(left, right) -> slot of rank and merged; the rank of a slot without a pair is NONE."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        self.table = Table(2 * len(left))
        slot = self.table.put(self._keys(np.asarray(left, np.int64), np.asarray(right, np.int64)))
        self.rank = np.full(len(self.table.keys), NONE)
        self.merged = np.zeros(len(self.table.keys), np.int64)
        self.rank[slot], self.merged[slot] = rank, merged

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left << 32) | right).astype(np.uint64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.find(self._keys(left, right))


#: Which of the candidates taken are thrown away: of words and the places in them of the first symbol that the candidate's left side was
#: made from, and what they would merge to.
Skip = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def merge(symbols: np.ndarray, length: np.ndarray, pairs: Pairs, skip: Skip | None = None, skip_one: Callable[[int, int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word after all merges, and how many each word has.

    skip(word, origin, merged) says which of the candidates taken from the agendas are thrown away; skip_one is the same for one
    candidate of a long word.
    """
    length = length.astype(np.int64)
    is_long = length > LONG
    if not is_long.any():
        return in_rounds(symbols, length, pairs, skip)
    begin = np.cumsum(length) - length
    of_long = np.repeat(is_long, length)
    at = np.flatnonzero(~is_long)
    ids, n = in_rounds(symbols[~of_long], length[~is_long], pairs, skip and (lambda word, origin, merged: skip(at[word], origin, merged)))
    each = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
    found = dict(zip(at.tolist(), each, strict=True))
    for i in np.flatnonzero(is_long).tolist():
        one = skip_one and (lambda origin, merged, i=i: skip_one(i, origin, merged))
        found[i] = by_heap(symbols[begin[i] : begin[i] + length[i]], pairs, one)
    parts = [found[i] for i in range(len(length))]
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def by_heap(symbols: np.ndarray, pairs: Pairs, skip: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """The symbols of one word after all merges: a heap of rank and place, and links to the next and the last symbol that is left.

    A pair at a place only grows, so a rank that is not that of the pair which is there now, or none, is out of date.
    """
    n = len(symbols)
    sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    slot = pairs(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
    rank = pairs.rank[slot]
    pending = np.where(rank < NONE, slot, -1).tolist()  # of each place: the slot of the pair that begins there
    pending.append(-1)
    at = np.flatnonzero(rank < NONE)
    heap = ((rank[at] << 32) | at).tolist()
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def candidate(i: int) -> None:
        j = after[i]
        if j >= n:
            pending[i] = -1
            return
        key = sym[i], sym[j]
        s = known.get(key)
        if s is None:
            s = int(pairs(np.array([key[0]], np.int64), np.array([key[1]], np.int64))[0])
            s = known[key] = s if pairs.rank[s] < NONE else -1
        pending[i] = s
        if s >= 0:
            heapq.heappush(heap, (int(pairs.rank[s]) << 32) | i)

    while heap:
        top = heapq.heappop(heap)
        i, s = top & 0xFFFFFFFF, pending[top & 0xFFFFFFFF]
        if s < 0 or pairs.rank[s] != top >> 32:
            continue
        merged = int(pairs.merged[s])
        if skip is not None and skip(i, merged):
            pending[i] = -1
            continue
        j = after[i]
        sym[i], sym[j], pending[j] = merged, None, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        candidate(i)
        if before[i] >= 0:
            candidate(before[i])
    return np.array([x for x in sym if x is not None], np.int64)


def in_rounds(symbols: np.ndarray, length: np.ndarray, pairs: Pairs, skip: Skip | None = None) -> tuple[np.ndarray, np.ndarray]:
    """merge(), with one candidate of every word at a time."""
    sym, length = symbols.astype(np.int64), length.astype(np.int64)
    word = np.arange(len(length))
    origin = np.arange(len(sym)) - np.repeat(np.cumsum(length) - length, length)
    slot, rank = np.zeros(len(sym), np.int64), np.full(len(sym), NONE)
    if len(sym) > 1:
        slot[:-1] = pairs(sym[:-1], sym[1:])
        rank[:-1] = pairs.rank[slot[:-1]]
    rank[np.cumsum(length)[length > 0] - 1] = NONE
    done_sym, done_word, done_length = [], [word[length == 0]], [length[length == 0]]
    word, length = word[length > 0], length[length > 0]
    while len(word):
        start = np.cumsum(length) - length
        least = np.minimum.reduceat(rank, start)
        live = least < NONE
        if not live.all():
            of = np.repeat(live, length)
            done_sym.append(sym[~of])
            done_word.append(word[~live])
            done_length.append(length[~live])
            sym, rank, slot, origin = sym[of], rank[of], slot[of], origin[of]
            word, length, least = word[live], length[live], least[live]
            if not len(word):
                break
            start = np.cumsum(length) - length
        lowest = np.flatnonzero(rank == np.repeat(least, length))
        at = lowest[np.searchsorted(lowest, start)]
        by = np.arange(len(word))
        merged = pairs.merged[slot[at]]
        if skip is not None:
            gone = skip(word, origin[at], merged)
            rank[at[gone]] = NONE
            at, by, merged = at[~gone], by[~gone], merged[~gone]
            if not len(at):
                continue
        sym[at] = merged
        length[by] -= 1
        kept = np.ones(len(sym), bool)
        kept[at + 1] = False
        sym, rank, slot, origin = sym[kept], rank[kept], slot[kept], origin[kept]
        at = at - np.arange(len(at))  # one symbol less for each merge before
        start = np.cumsum(length) - length
        stop = (start + length - 1)[by]
        right = at[at < stop]
        left = at[at > start[by]] - 1
        rank[at[at == stop]] = NONE
        for x in (right, left):
            slot[x] = pairs(sym[x], sym[x + 1])
            rank[x] = pairs.rank[slot[x]]
    words, length = np.concatenate(done_word), np.concatenate(done_length)
    sym = np.concatenate(done_sym) if done_sym else sym[:0]
    order = np.argsort(words, kind="stable")
    begin = (np.cumsum(length) - length)[order]
    length = length[order]
    flat = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return sym[flat], length
