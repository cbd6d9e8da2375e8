"""SentencePiece BPE with seeded merge-dropout, and its decoding.

Encoding starts from single characters and takes candidate merges from an agenda, best score first, the leftmost of
equals; each candidate taken is skipped with a set probability, as a keyed hash says, and otherwise merged. Without
dropout this gives the library's own pieces. With it a word gets varied pieces, all made by merges of the
vocabulary, that decode to the same text. Pieces never join across the start of a word, so words are worked out one by
one. The key of the hash is the seed, the document, the word and its place, so dropout is drawn for each occurrence, and a
run repeats itself, wherever a document is worked on. What is remembered of a word is its pieces without dropout and the
candidates that lead to them: where none of these is skipped, an occurrence has those pieces; all others are worked out anew.

Cases: a null or empty text has no pieces, and decodes to the empty text; characters that the vocabulary lacks, and the
character that stands for a space, are bytes, so that all texts decode as they were; documents of one id and text get the same
pieces; a null doc_id counts as a number of its own; an empty table gives an empty result; columns may have any other names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .merges import Memo, Pairs, Skip, merge, spans
from .text import Texts, mixed, mixed_one, texts

SPACE = "▁"


def mixed_quietly(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(x)


class Model:
    """The pieces of a .model file of kind BPE with byte fallback, a space before each text, and no normalisation."""

    def __init__(self, path: str, dropout: float, seed: int, most_words: int = 200_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        name = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        number = {name[i]: i for i in normal}
        is_normal = set(normal)
        if any(SPACE in name[i].lstrip(SPACE) for i in normal):
            raise ValueError("pieces of this model join across words")
        score = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-score, return_inverse=True)[1]
        both = [(number[p[:k]], number[p[k:]], i) for p, i in number.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, merged = (np.array(x, np.int64) for x in zip(*both, strict=True))
        self.pairs = Pairs(left, right, rank[merged], merged)
        #: Of each code point: its piece, or the code point less 2**21 where it has none and becomes bytes.
        self.symbol = np.arange(0x110000, dtype=np.int64) - (1 << 21)
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = number[SPACE]
        self.symbol[ord(SPACE)] = ord(SPACE) - (1 << 21)
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        spelled = [bytes([int(name[i][3:5], 16)]) if model.is_byte(i) else name[i].replace(SPACE, " ").encode() * (i in is_normal) for i in range(n)]
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.seed = np.uint64(seed)
        self.limit = np.uint64(min(max(dropout, 0.0), 1.0) * float((1 << 64) - 2048))
        self.memo = Memo(most_words, 10 * most_words)

    def _place(self, origin: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """A hash of a candidate in its word."""
        with np.errstate(over="ignore"):
            return mixed(origin.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + merged.astype(np.uint64) + self.seed)

    def _place_one(self, origin: int, merged: int) -> int:
        return mixed_one((origin * 0xD1342543DE82EF95 + merged + int(self.seed)) & 0xFFFFFFFFFFFFFFFF)

    def _work_out(self, data: bytes, length: np.ndarray, skip: Skip, skip_one: Callable[[int, int, int], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, each of some bytes of data."""
        code = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        end = np.cumsum(length)
        sym, n = merge(self.symbol[code], lead[end] - lead[end - length], self.pairs, skip, skip_one)
        rare = sym < 0
        if not rare.any():
            return sym, n
        point = np.where(rare, sym + (1 << 21), 0)
        size = 1 + np.where(rare, (point > 0x7F).astype(int) + (point > 0x7FF) + (point > 0xFFFF), 0)
        of = np.repeat(np.arange(len(sym)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        shift = 6 * (size[of] - 1 - place)
        mark = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[of]]
        octet = np.where(place > 0, 0x80 | ((point[of] >> shift) & 0x3F), mark | (point[of] >> shift))
        owner = np.repeat(np.arange(len(n)), n)
        return np.where(rare[of], self.byte[octet], sym[of]), np.bincount(owner[of], minlength=len(n))

    def _undropped(self, data: bytes, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is remembered of units: how many candidates were taken, the low and high halves of their hashes, and the ids."""
        words, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

        def note(word: np.ndarray, origin: np.ndarray, merged: np.ndarray) -> np.ndarray:
            words.append(word)
            places.append(self._place(origin, merged))
            return np.zeros(len(word), bool)

        long: list[tuple[int, int, int]] = []
        ids, n = self._work_out(data, length, note, lambda *taken: long.append(taken))
        if long:
            note(*(np.array(x, np.int64) for x in zip(*long, strict=True)))
        word, place = np.concatenate(words), np.concatenate(places)
        place = place[np.argsort(word, kind="stable")]
        taken = np.bincount(word, minlength=len(length))
        size = 1 + 2 * taken + n
        begin = np.cumsum(size) - size
        out = np.zeros(size.sum(), np.uint32)
        out[begin] = taken
        out[spans(begin + 1, taken)] = place & np.uint64(0xFFFFFFFF)
        out[spans(begin + 1 + taken, taken)] = place >> np.uint64(32)
        out[spans(begin + 1 + 2 * taken, n)] = ids
        return out, size

    def encode(self, column: pa.Array, salts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Texts]]:
        """For some texts after the other: all ids, where each text's begin, with the end, and the texts with a space before each.

        salts: a 64-bit number for each text; the key of an occurrence has it, the seed, the word and its place.
        """
        done = 0
        for t in texts(column):
            full = np.diff(t.offsets) > 0
            t = Texts(np.insert(t.data, t.offsets[:-1][full], 32), t.offsets + np.concatenate([[0], np.cumsum(full)]))
            # a unit is a word with the white space before it, or white space at the end of a text
            stops = np.unique(np.concatenate([t.ends, t.offsets[1:][full]]))
            starts = np.concatenate([[0], stops[:-1]])
            first = np.searchsorted(starts, t.offsets)
            n_units = np.diff(first)
            place = np.arange(len(starts)) - np.repeat(first[:-1], n_units)
            salt = np.repeat(salts[done : done + len(t)], n_units)
            done += len(t)
            words = t.hashes(starts, stops)

            def spelled(at: np.ndarray, t=t, starts=starts, stops=stops) -> tuple[bytes, np.ndarray]:
                length = stops[at] - starts[at]
                return t.data[spans(starts[at], length)].tobytes(), length

            flat, size = self.memo.get(words, t.data, starts, stops, lambda at, spelled=spelled: self._undropped(*spelled(at)))
            begin = np.cumsum(size) - size
            taken = flat[begin].astype(np.int64)
            n = size - 1 - 2 * taken
            if self.limit:
                with np.errstate(over="ignore"):
                    keys = mixed(words + mixed(salt + mixed(place.astype(np.uint64) + self.seed)))
                low, high = (flat[spans(begin + 1 + k * taken, taken)].astype(np.uint64) for k in (0, 1))
                of = np.repeat(np.arange(len(n)), taken)
                again = np.zeros(len(n), bool)
                again[of[mixed_quietly(keys[of] ^ (low | high << np.uint64(32))) < self.limit]] = True
                at = np.flatnonzero(again)
                own = keys[at]
                ids, n_own = self._work_out(
                    *spelled(at),
                    lambda word, origin, merged, own=own: mixed_quietly(own[word] ^ self._place(origin, merged)) < self.limit,
                    lambda word, origin, merged, own=own: mixed_one(int(own[word]) ^ self._place_one(origin, merged)) < int(self.limit),
                )
                begin[at], taken[at], n[at] = len(flat) - 1 + np.cumsum(n_own) - n_own, 0, n_own
                flat = np.concatenate([flat, ids])
            flat = flat[spans(begin + 1 + 2 * taken, n)].astype(np.int64)
            yield flat, np.concatenate([[0], np.cumsum(n)])[first], t

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes of ids, with the space before a text."""
        n = self.length[ids]
        return self.spelling[spans(self.begin[ids], n)]


@functools.cache
def model(path: str, dropout: float, seed: int) -> Model:
    """One for each Python worker, kept from task to task."""
    return Model(path, dropout, seed)


def salts(doc_id: pa.Array) -> np.ndarray:
    """A number for each document."""
    return mixed(doc_id.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64))


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))


def encode(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id and ids of each document."""

    def run(batches):
        for batch in batches:
            ids, done = batch.column(0), 0
            for flat, at, t in model(path, dropout, seed).encode(batch.column(1), salts(ids)):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(t)), lists], ["doc_id", "ids"])
                done += len(t)

    return keyed_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from doc_id and ids; null ids are a null text."""

    def run(batches):
        m = model(path, 0.0, 0)
        for batch in batches:
            found = [None if x is None else m.decode(np.array(x, np.int64)).tobytes()[1:].decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """For each document: doc_id, n_bytes, n_pieces, ids_crc32 (little-endian unsigned 32-bit), decoded_crc32 and lossless."""

    def run(batches):
        names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_crc32", "lossless"]
        m = model(path, dropout, seed)
        for batch in batches:
            ids, done = batch.column(0), 0
            for flat, at, t in m.encode(batch.column(1), salts(ids)):
                back = m.decode(flat)
                ends = np.concatenate([[0], np.cumsum(m.length[flat])])[at].tolist()
                raw, spelled, whole = flat.astype("<u4").tobytes(), back.tobytes(), t.data.tobytes()
                at, begin = at.tolist(), t.offsets.tolist()
                rows = range(len(t))
                columns = [
                    pa.array([max(0, begin[i + 1] - begin[i] - 1) for i in rows], pa.int64()),
                    pa.array([at[i + 1] - at[i] for i in rows], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * at[i] : 4 * at[i + 1]]) for i in rows], pa.int64()),
                    pa.array([zlib.crc32(spelled[ends[i] + 1 : ends[i + 1]]) for i in rows], pa.int64()),
                    pa.array([spelled[ends[i] : ends[i + 1]] == whole[begin[i] : begin[i + 1]] for i in rows], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(t)), *columns], names)
                done += len(t)

    return keyed_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean")
