"""Fill-in-the-middle: a text's prefix, middle and suffix in another order, with sentinels, and back.

A text is cut into units, each a word with the white space before it, and white space at the end. Two cuts come from the hash of the
document. Bytes of a text are in fixed blocks; a Fenwick tree has how many units end in each block, and one how many code points begin there.
A descent by powers of two finds the block where the unit ends that a cut comes after, and only that block is searched for the place. So the
units are never listed, and a long text costs its blocks.

The parts hold no sentinel, and a sentinel's own characters cannot make another one across its ends, so the first ones found give
the parts back.

Cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays plain; repeated rows get the same; a null doc_id
is hashed as the empty string; texts may be long or without white space; an empty table gives an empty result; columns may have any
other names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole_text
from .text import Texts, texts

#: Bytes of a block.
BLOCK = 4096
SENTINELS = (b"<P>", b"<S>", b"<M>")


class Fenwick:
    """Sums over the first blocks."""

    def __init__(self, counts: np.ndarray) -> None:
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(len(sums))
        self.tree = (sums - sums[at - (at & -at)]).tolist()

    def before(self, block: int) -> int:
        """The sum of the first ``block`` blocks."""
        found = 0
        while block:
            found += self.tree[block]
            block &= block - 1
        return found

    def find(self, k: int) -> tuple[int, int]:
        """The block with the k-th, from 1, and the sum before it."""
        at, left, step = 0, k, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step] < left:
                at += step
                left -= self.tree[at]
            step >>= 1
        return at, k - left


class Blocks:
    """Some texts, with what their blocks hold."""

    def __init__(self, t: Texts, size: int = BLOCK) -> None:
        self.t, self.size = t, size
        n = len(t.data)
        self.is_end = np.zeros(n, bool)
        self.is_end[t.ends - 1] = True
        self.is_end[t.offsets[1:][np.diff(t.offsets) > 0] - 1] = True
        self.is_code = (t.data & 0xC0) != 0x80
        blocks = -(-np.diff(t.offsets) // size)
        #: The blocks of text i are numbers first[i] to first[i + 1].
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        begin = np.repeat(t.offsets[:-1] - self.first[:-1] * size, blocks) + np.arange(self.first[-1]) * size
        count = lambda x: np.add.reduceat(x, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
        self.ends, self.codes = count(self.is_end), count(self.is_code)

    def cuts(self, i: int, of: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        """How many units text i has, and after the numbers of units that ``of`` gives modulo one more, in order: bytes and code points."""
        begin, end = int(self.t.offsets[i]), int(self.t.offsets[i + 1])
        mine = slice(self.first[i], self.first[i + 1])
        units, codes = Fenwick(self.ends[mine]), Fenwick(self.codes[mine])
        n = units.before(len(units.tree) - 1)
        out = []
        for k in sorted(x % (n + 1) for x in of):
            if not k:
                out.append((0, 0))
                continue
            block, before = units.find(k)
            low = begin + block * self.size
            stop = low + int(np.flatnonzero(self.is_end[low : min(low + self.size, end)])[k - before - 1]) + 1
            out.append((stop - begin, codes.before(block) + int(np.count_nonzero(self.is_code[low:stop]))))
        return n, out


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """The first four groups of eight hexadecimal digits of the document's hash."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output of each document.

    rate: of 100 texts, how many are not plain; suffix_first: of 100 of these, how many begin with the suffix.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    p, s, m = SENTINELS

    def run(batches):
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for t in texts(batch.column(1)):
                blocks, raw, rows = Blocks(t), t.data.tobytes(), []
                for i, (a, b) in enumerate(zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)):
                    text, h = raw[a:b], drawn(seed, ids[done + i])
                    n, ((p_bytes, p_chars), (m_bytes, m_chars)) = blocks.cuts(i, (h[0], h[1]))
                    if not text or h[2] % 100 >= rate or any(x in text for x in SENTINELS):
                        rows.append((n, "plain", None, None, text))
                        continue
                    prefix, middle, suffix = text[:p_bytes], text[p_bytes:m_bytes], text[m_bytes:]
                    spm = h[3] % 100 < suffix_first
                    output = (s + suffix + p + prefix if spm else p + prefix + s + suffix) + m + middle
                    rows.append((n, "spm" if spm else "psm", p_chars, m_chars - p_chars, output))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(x, pa.binary() if k == 4 else kind).cast(kind) for k, (x, kind) in enumerate(zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(t)), *columns], names)
                done += len(t)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return keyed.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    psm = F.regexp_replace(output, r"(?s)\A<P>(.*?)<S>(.*?)<M>(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, r"(?s)\A<S>(.*?)<P>(.*?)<M>(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """transform() with the hashes of the output and of the text rebuilt from it in place of the output."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    made = transform(docs)
    output, back = sha(F.col("output")), sha(restored(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output_sha256"), back.alias("restored_sha256"))
