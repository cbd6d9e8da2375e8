"""How far the sources of a language differ in their terms: an audit over whole texts, in exact arithmetic.

A term never holds white space, so a text's terms are those of its chunks between white space, one after the other. Chunks repeat far more
than texts do, so they are factored out:

1. Each task counts the chunks of each document, and sums them up by language and chunk: how often each source has the chunk, and in
   which documents it is.
2. All counts of a chunk meet in one task, in order. There each distinct chunk is taken apart once, and its terms are joined to
   its counts.
3. All counts of a term in a language meet likewise. A term is kept if enough documents of the language have it.
4. Each task works out, for the kept terms that it has, what they add to each two sources, and the terms furthest above their share.

Of documents only two are named: from three on they are enough, whichever they are. So what is shuffled for a chunk or a term is two
numbers and the counts of the sources that have it, and a task holds the counts of one at a time, or of a bounded number.

Counts give shares, p = 1 + floor(10^9 (count + 1) / (N + V)), and shares the divergence of a source from another, the sum of
f(p, q) = floor((p - q)^2 / q) over the kept terms. Most sources lack most terms. A term that both lack adds the same for all such terms, and one that
one lacks depends on the other's count only. So only the terms that both have are paired:

    sum over both of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)] + sum over all of f(p, q0) + sum over all of f(p0, q) - V f(p0, q0)

with p0 and q0 the shares of what is not there.

Cases: null texts, languages and sources count as empty strings; a row is a document, whatever its doc_id; a language without kept terms
has divergences of 0; an empty table gives an empty result; a chunk may be as long as its text; columns may have any other names. Languages and
sources have a number each, and N and V of all of them go to all tasks: at most MOST_GROUPS, as the result has a row for each two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, written
from .text import LOWER, Texts, texts

#: Documents that a kept term has at least. Two are named in counts, so this is 3 or less.
LEAST_DOCS = 3
#: Rows and bytes of counts that a task holds, and rows that it merges at once; languages and sources that there may be.
MOST_ROWS, MOST_BYTES, AT_ONCE, MOST_GROUPS = 800_000, 64_000_000, 100_000, 1_000_000
#: In place of documents: three or more.
MANY = -1
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PART = np.dtype([("g", "<i4"), ("n", "<i8")])
SHARE = 10**9


def strings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The spans of data, as strings."""
    size = stops - starts
    end = np.cumsum(size)
    at = np.repeat(starts - (end - size), size) + np.arange(end[-1] if len(end) else 0)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], end]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at])))


def spelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins, with the end."""
    column = column.cast(pa.large_string())
    n, (_, at, data) = len(column), column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


@dataclass
class Counts:
    """Counts of strings: for each its language, the documents that have it (the first and last, or MANY twice), and parts, how often each source (g) has it."""

    lang: np.ndarray
    text: pa.Array
    first: np.ndarray
    last: np.ndarray
    size: np.ndarray
    g: np.ndarray
    n: np.ndarray

    NAMES = ("lang", "text", "first", "last", "parts")
    KIND = "lang int, text string, first long, last long, parts binary"

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table) -> Counts:
        column = lambda k: c.combine_chunks() if isinstance(c := batch.column(k), pa.ChunkedArray) else c
        number = lambda k: column(k).to_numpy(zero_copy_only=False)
        raw, at = spelled_binary(column(4))
        parts = np.frombuffer(raw[at[0] : at[-1]].tobytes(), PART)
        return cls(number(0), column(1).cast(pa.large_string()), number(2), number(3), np.diff(at) // PART.itemsize, parts["g"].astype(np.int64), parts["n"].astype(np.int64))

    @property
    def weight(self) -> int:
        """Rows, or as many as fit the bytes."""
        return len(self.lang) + (self.text.nbytes + PART.itemsize * len(self.g)) * AT_ONCE // MOST_BYTES

    def batches(self, rows: int = 5000) -> Iterator[pa.RecordBatch]:
        parts = np.empty(len(self.g), PART)
        parts["g"], parts["n"] = self.g, self.n
        end = np.concatenate([[0], np.cumsum(self.size * PART.itemsize)]).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.size), [None, pa.py_buffer(end), pa.py_buffer(parts.tobytes())])
        for lo in range(0, len(self.size), rows):
            part = slice(lo, lo + rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.lang[part], pa.int32()), self.text[part].cast(pa.string()), pa.array(self.first[part]), pa.array(self.last[part]), packed[part].cast(pa.binary())], list(self.NAMES)
            )

    def take(self, at: np.ndarray) -> Counts:
        """The rows at some places, in that order."""
        begin = np.cumsum(self.size) - self.size
        size = self.size[at]
        flat = np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Counts(self.lang[at], self.text.take(pa.array(at)), self.first[at], self.last[at], size, self.g[flat], self.n[flat])

    def merged(self, run: np.ndarray) -> Counts:
        """One row for each run; run numbers the rows' runs from 0, in order."""
        if not len(run) or run[-1] == len(run) - 1:
            return self
        at = np.flatnonzero(np.diff(run, prepend=-1))
        key = np.repeat(run, self.size) * (int(self.g.max(initial=0)) + 1) + self.g
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        g, n, of = self.g[order][begin], np.add.reduceat(self.n[order], begin), np.repeat(run, self.size)[order][begin]
        # documents: those named, each once
        few = np.flatnonzero(self.first != MANY)
        doc, mine = np.concatenate([self.first[few], self.last[few]]), np.tile(run[few], 2)
        order = np.lexsort((doc, mine))
        doc, mine = doc[order], mine[order]
        own = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mine[1:] != mine[:-1])])) if len(doc) else np.zeros(0, np.int64)
        docs = np.bincount(mine[own], minlength=len(at))
        docs[run[self.first == MANY]] = LEAST_DOCS
        first, last = np.full(len(at), MANY, np.int64), np.full(len(at), MANY, np.int64)
        doc, mine = doc[own], mine[own]
        last[mine] = doc
        first[mine[::-1]] = doc[::-1]
        first[docs >= LEAST_DOCS] = last[docs >= LEAST_DOCS] = MANY
        return Counts(self.lang[at], self.text.take(pa.array(at)), first, last, np.bincount(of, minlength=len(at)), g, n)


def spelled_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    n, (_, at, data) = len(column), column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def joined(parts: list[Counts]) -> Counts:
    if len(parts) == 1:
        return parts[0]
    arrays = {k: np.concatenate([getattr(p, k) for p in parts]) for k in ("lang", "first", "last", "size", "g", "n")}
    return Counts(text=pa.concat_arrays([p.text for p in parts]), **arrays)


def runs(*columns: np.ndarray) -> np.ndarray:
    """The number of the run of equal values that each row is in."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def by_text(counts: Counts) -> Counts:
    """Rows of equal language and text as one, in no order."""
    code = counts.text.dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((counts.lang, code))
    counts, code = counts.take(order), code[order]
    return counts.merged(runs(code, counts.lang))


def counted(t: Texts, g: np.ndarray, lang_of: np.ndarray, begin: int) -> Counts:
    """The chunks of some texts of sources g; the texts are numbered from begin."""
    found = strings(t.data, t.starts, t.ends).dictionary_encode()
    size = max(1, len(found.dictionary))
    of = np.repeat(np.arange(len(t)), t.n_words)
    each, n = np.unique(of * size + found.indices.to_numpy(), return_counts=True)  # the chunks of each document
    doc, chunk = each // size, each % size
    group = g[doc]
    order = np.lexsort((group, lang_of[group], chunk))
    doc, chunk, group, n = doc[order], chunk[order], group[order], n[order]
    rows = Counts(lang_of[group], found.dictionary.take(pa.array(chunk)), doc + begin, doc + begin, np.ones(len(doc), np.int64), group, n)
    return rows.merged(runs(chunk, rows.lang))


def chunk_counts(docs: DataFrame, lang_of: np.ndarray) -> DataFrame:
    """Counts of chunks, as each task has them; docs has g and text."""
    sent = docs.sparkSession.sparkContext.broadcast(lang_of)

    def run(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            g, done = batch.column(0).to_numpy().astype(np.int64), 0
            for t in texts(batch.column(1)):
                held.append(counted(t, g[done : done + len(t)], sent.value, number))
                done, number = done + len(t), number + len(t)
                size += len(held[-1].g) + (len(t.data) * MOST_ROWS) // MOST_BYTES
                if size > MOST_ROWS:
                    one = by_text(joined(held))
                    held, size = [one], len(one.g) + (one.text.nbytes * MOST_ROWS) // MOST_BYTES
                    if 2 * size > MOST_ROWS:
                        yield from one.batches()
                        held, size = [], 0
        if held:
            yield from by_text(joined(held)).batches()

    return docs.mapInArrow(run, Counts.KIND)


def met(counts: DataFrame, *keys: str, use: Callable[[Iterator[Counts]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What use makes of whole merged rows: all rows of a text (and language, if that is a key) in one task, one after the other."""

    def run(batches):
        def whole():
            held: list[Counts] = []
            rows = 0
            for batch in batches:
                held.append(Counts.read(batch))
                rows += held[-1].weight
                if rows < AT_ONCE:
                    continue
                one = merge(joined(held))
                # the last text may go on
                data, at = spelled(one.text)
                last = data[at[-2] : at[-1]].tobytes()
                stop = len(one.lang) - 1
                while stop and data[at[stop - 1] : at[stop]].tobytes() == last:
                    stop -= 1
                if stop:
                    yield one.take(np.arange(stop))
                held = [one.take(np.arange(stop, len(one.lang)))]
                rows = held[0].weight
            if held:
                yield merge(joined(held))

        yield from use(whole())

    def merge(counts: Counts) -> Counts:
        code = counts.text.dictionary_encode().indices.to_numpy()
        return counts.merged(runs(code, counts.lang))

    dealt = counts.repartition(*keys).sortWithinPartitions("text", "lang")
    return dealt.mapInArrow(run, Counts.KIND)


def terms(chunks: Iterator[Counts]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of chunks: each chunk is taken apart once, for all its languages."""
    held, rows = [], 0
    for counts in chunks:
        data, at = spelled(counts.text)
        # rows of one chunk in several languages follow each other
        own = np.flatnonzero(np.diff(runs(counts.text.dictionary_encode().indices.to_numpy()), prepend=-1))
        inside = IN_TERM[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[at[at < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[at[at > 0] - 1] = False
        starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(at, starts, "right") - 1
        mine = np.isin(row, own)
        starts, stops, row = starts[mine], stops[mine], row[mine]
        times = np.diff(np.append(own, len(counts.lang)))[np.searchsorted(own, row)]  # languages of the chunk
        rows_of = np.repeat(row - (np.cumsum(times) - times), times) + np.arange(times.sum())
        found = strings(LOWER[data], starts, stops)
        out = counts.take(rows_of)
        out.text = found.take(pa.array(np.repeat(np.arange(len(starts)), times)))
        held.append(out)
        rows += out.weight
        if rows > AT_ONCE:
            one = by_text(joined(held))
            yield from one.batches()
            held, rows = [], 0
    if held:
        yield from by_text(joined(held)).batches()


def kept(counts: Iterator[Counts]) -> Iterator[pa.RecordBatch]:
    """Of merged counts those of enough documents."""
    for c in counts:
        yield from c.take(np.flatnonzero(c.first == MANY)).batches()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 count / total), by long division in steps of 1000, which 64 bits hold."""
    q, r = np.divmod(count, total)
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // total, r % total
    return 1 + q


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


@dataclass(frozen=True)
class Groups:
    """For each source its language, n (the sum of its counts), and has (its terms); for each language v (kept terms) and its own n."""

    lang: np.ndarray
    n: np.ndarray
    has: np.ndarray
    v: np.ndarray
    lang_n: np.ndarray

    @property
    def none(self) -> np.ndarray:
        """The share of a term that a source lacks; 1 where there are no terms."""
        total = self.n + self.v[self.lang]
        return share(np.minimum(total, 1), np.maximum(total, 1))


class Sums:
    """Exact sums by a pair of sources, of numbers of 64 bits."""

    LIMIT = 1_000_000

    def __init__(self, groups: int) -> None:
        self.groups, self.held, self.size = groups, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> None:
        self.held.append(self._sum(a * self.groups + b, x >> 32, x & 0xFFFFFFFF))
        self.size += len(self.held[-1][0])
        if self.size > self.LIMIT:
            self.held = [self._sum(*(np.concatenate(c) for c in zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])

    @staticmethod
    def _sum(key: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, high, low = key[order], high[order], low[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        high, low = (np.add.reduceat(x, at) if len(at) else x for x in (high, low))
        return key[at], high + (low >> 32), low & 0xFFFFFFFF

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[Decimal]]]:
        if self.held:
            key, high, low = self._sum(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            self.held, self.size = [], 0
            for lo in range(0, len(key), 10_000):
                k, h, w = key[lo : lo + 10_000], high[lo : lo + 10_000].tolist(), low[lo : lo + 10_000].tolist()
                yield k // self.groups, k % self.groups, [Decimal((x << 32) + y) for x, y in zip(h, w, strict=True)]


class Furthest:
    """The ``most`` terms of each source by value, the first in order of bytes among equals."""

    def __init__(self, groups: int, most: int) -> None:
        self.most, self.least = most, np.full(groups, -1, np.int64)
        self.held, self.rows = [], 0

    def add(self, g: np.ndarray, value: np.ndarray, text: pa.Array, row: np.ndarray) -> None:
        near = value >= self.least[g]
        self.held.append(pa.table({"g": g[near], "value": value[near], "text": text.take(pa.array(row[near]))}))
        self.rows += len(self.held[-1])
        if self.rows > AT_ONCE + 2 * self.most * len(self.least):
            self.cut()

    def cut(self) -> pa.Table:
        found = pa.concat_tables(self.held)
        found = found.take(pc.sort_indices(found, [("g", "ascending"), ("value", "descending"), ("text", "ascending")])).combine_chunks()
        g = found.column("g").to_numpy()
        begin = np.flatnonzero(np.diff(g, prepend=-1))
        place = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
        full = np.flatnonzero(place == self.most - 1)
        self.least[g[full]] = found.column("value").to_numpy()[full]
        found = found.filter(pa.array(place < self.most))
        self.held, self.rows = [found], len(found)
        return found


FOUND = "a long, b long, text string, value decimal(38,0)"


def compared(counts: DataFrame, groups: Groups, most: int) -> DataFrame:
    """Of all kept terms: rows (a, b, value) that add up to the divergence of source a from b, but for what neither has; and rows (a, text, value), the furthest terms of each task."""
    sent = counts.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        gr = sent.value
        n_groups, none = len(gr.lang), gr.none
        total, lang_total = gr.n + gr.v[gr.lang], gr.lang_n + gr.v
        sums, furthest = Sums(n_groups), Furthest(n_groups, most)
        shares: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        members = [np.flatnonzero(gr.lang == x) for x in range(len(gr.v))]

        def apart() -> None:
            """What the shares that a source has add to its pairs with all others, whatever these have."""
            g, p, k = (np.concatenate(c) for c in zip(*shares, strict=True))
            order = np.lexsort((p, g))
            run = runs(g[order], p[order])
            at = np.flatnonzero(np.diff(run, prepend=-1))
            g, p, k = g[order][at], p[order][at], np.add.reduceat(k[order], at)
            shares[:] = [(g, p, k)]
            for lo in range(0, len(g), 1000):
                x, y, z = g[lo : lo + 1000], p[lo : lo + 1000], k[lo : lo + 1000]
                others = [members[v] for v in gr.lang[x]]
                size = np.fromiter(map(len, others), np.int64, len(others))
                of, other = np.repeat(np.arange(len(x)), size), np.concatenate(others)
                differ = x[of] != other
                of, other = of[differ], other[differ]
                for a, b, value in ((x[of], other, gap(y[of], none[other])), (other, x[of], gap(none[other], y[of]))):
                    for part in np.array_split(np.arange(len(a)), max(1, len(a) // 1_000_000)):
                        times(sums, a[part], b[part], value[part], z[of][part])

        for batch in batches:
            c = Counts.read(batch)
            row = np.repeat(np.arange(len(c.lang)), c.size)
            p = share(c.n + 1, total[c.g])
            q = share(np.add.reduceat(c.n, np.cumsum(c.size) - c.size) + 1, lang_total[c.lang])[row] if len(c.lang) else p
            above = p > q
            furthest.add(c.g[above], gap(p[above], q[above]), c.text, row[above])
            order = np.lexsort((p, c.g))
            run_ = runs(c.g[order], p[order]) if len(p) else p
            at = np.flatnonzero(np.diff(run_, prepend=-1))
            shares.append((c.g[order][at], p[order][at], np.diff(np.append(at, len(p)))))
            if sum(len(x[0]) for x in shares) > MOST_ROWS:
                apart()
                shares.clear()
            # each entry of a term with each later one of the same term
            later = np.repeat(np.cumsum(c.size), c.size) - np.arange(len(p)) - 1
            for lo, hi in blocks(later, 1_000_000):
                m = later[lo:hi]
                i = np.repeat(np.arange(lo, hi), m)
                j = i + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                x, y, x0, y0, a, b = p[i], p[j], none[c.g[i]], none[c.g[j]], c.g[i], c.g[j]
                sums.add(a, b, gap(x, y) - gap(x, y0) - gap(x0, y) + gap(x0, y0))
                sums.add(b, a, gap(y, x) - gap(y, x0) - gap(y0, x) + gap(y0, x0))
        if shares:
            apart()
        names = ["a", "b", "text", "value"]
        kind = pa.decimal128(38, 0)
        for a, b, value in sums.take():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.string()), pa.array(value, kind)], names)
        if furthest.held:
            for x in furthest.cut().to_batches(max_chunksize=5000):
                value = pa.array([Decimal(v) for v in x.column("value").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([x.column("g"), pa.nulls(len(x), pa.int64()), x.column("text").cast(pa.string()), value], names)

    return counts.mapInArrow(run, FOUND)


def times(sums: Sums, a: np.ndarray, b: np.ndarray, x: np.ndarray, k: np.ndarray) -> None:
    """Adds x k times; both have 64 bits, so that the product is made of halves."""
    key = a * sums.groups + b
    high, low = (x >> 32) * k, (x & 0xFFFFFFFF) * k  # a share that is there k times adds up to 2^62 at most
    sums.held.append(sums._sum(key, high + (low >> 32), low & 0xFFFFFFFF))
    sums.size += len(sums.held[-1][0])
    if sums.size > sums.LIMIT:
        sums.held = [sums._sum(*(np.concatenate(c) for c in zip(*sums.held, strict=True)))]
        sums.size = len(sums.held[0][0])


def blocks(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places with about ``most`` in all."""
    end = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def totals(counts: DataFrame, lang_of: np.ndarray, langs: int) -> Groups:
    """Sums over all kept terms, made in tasks."""

    def run(batches):
        n, has, v = (np.zeros(k, np.int64) for k in (len(lang_of), len(lang_of), langs))
        for batch in batches:
            c = Counts.read(batch)
            np.add.at(n, c.g, c.n)
            has += np.bincount(c.g, minlength=len(n))
            v += np.bincount(c.lang, minlength=len(v))
        for kind, x in enumerate((n, has, v)):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(x[at])], ["kind", "at", "x"])

    found = counts.mapInArrow(run, "kind long, at long, x long").groupBy("kind", "at").agg(F.sum("x").alias("x")).toArrow()
    kind, at, x = (found.column(k).to_numpy() for k in range(3))
    each = [np.zeros(k, np.int64) for k in (len(lang_of), len(lang_of), langs)]
    for k in range(3):
        each[k][at[kind == k]] = x[kind == k]
    lang_n = np.zeros(langs, np.int64)
    np.add.at(lang_n, lang_of, each[0])
    return Groups(lang_of, each[0], each[1], each[2], lang_n)


def audit(docs: DataFrame, most: int = 200) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: a source against each other one of its language, and its ``most`` terms that
    exceed their share in the language furthest."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")])
    pairs = sorted((r["lang"], r["source"]) for r in docs.select("lang", "source").distinct().limit(MOST_GROUPS + 1).collect())
    if len(pairs) > MOST_GROUPS:
        raise ValueError(f"there are more than {MOST_GROUPS} languages and sources")
    langs = sorted({x for x, _ in pairs})
    number = {x: i for i, x in enumerate(langs)}
    lang_of = np.array([number[x] for x, _ in pairs], np.int64)
    names = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "g long, lang string, source string")
    with Workspace(spark, "divergence") as work:
        numbered = docs.join(F.broadcast(names), ["lang", "source"]).select("g", "text")
        found = met(met(chunk_counts(numbered, lang_of), "text", use=terms), "text", "lang", use=kept)
        counts = work.written(found, "kept")
        groups = totals(counts, lang_of, len(langs))
        parts = work.written(compared(counts, groups, most), "compared")
        # terms that a source lacks: what is the same for all of them
        a, b = (np.array(x, np.int64) for x in zip(*every_two(lang_of), strict=True)) if len(pairs) > len(langs) else (np.zeros(0, np.int64),) * 2
        none, v = groups.none, groups.v[lang_of]
        lack = [Decimal((int(v[i]) - int(groups.has[i]) - int(groups.has[j])) * int(x)) if v[i] else Decimal(0) for i, j, x in zip(a.tolist(), b.tolist(), gap(none[a], none[b]).tolist(), strict=True)]
        base = spark.createDataFrame(pa.table({"a": a, "b": b, "value": pa.array(lack, pa.decimal128(38, 0))})) if len(a) else spark.createDataFrame([], "a long, b long, value decimal(38,0)")
        pair = parts.where("text is null").select("a", "b", "value").union(base).groupBy("a", "b").agg(F.sum("value").cast("long").alias("value"))
        other = F.broadcast(names.select(F.col("g").alias("b"), F.col("source").alias("item")))
        pair = pair.join(other, "b").select("a", F.lit("pair").alias("part"), "item", "value")
        term = parts.where("text is not null").select("a", F.lit("term").alias("part"), F.col("text").alias("item"), F.col("value").cast("long").alias("value"))
        rank = F.row_number().over(Window.partitionBy("a", "part").orderBy(F.desc("value"), "item"))
        ranked = pair.unionByName(term).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= most))
        out = ranked.join(F.broadcast(names.withColumnRenamed("g", "a")), "a").select("lang", "source", "part", "item", "value", "rank")
        return written(out, "divergence")


def every_two(lang_of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Each two sources of a language, in both orders: as many as the result has rows for them."""
    for x in range(int(lang_of.max(initial=-1)) + 1):
        mine = np.flatnonzero(lang_of == x).tolist()
        yield from ((i, j) for i in mine for j in mine if i != j)
