"""Token ids of whole texts as the public tokenizers' libraries give them, faster.

A tokenizer that drops white space and never joins across it gives a text the ids of its words, one after the other.
For such a tokenizer a word's ids are worked out once and remembered, beside the word, for a bounded number
of words: for words of common Latin letters and printable ASCII by numpy merges of the vocabulary's own pairs, for all
others by the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .merges import Memo, Pairs, merge
from .text import LOWER, Texts, texts

#: Characters that are in composed form, and whose lower case does not hang on their neighbours.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ\n]*")
#: The split of the tokenizer, for plain words in lower case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: The same in the tokenizer's own file.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(path: str) -> dict | None:
    """The description of a .json tokenizer that the word-wise way holds for; else None."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = (spec.get("normalizer") or {}).get("normalizers") or []
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec["model"]
    fits = (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1]["pattern"] == {"Regex": "\\s+"}
        and normal[1]["content"] == " "
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"] == {"Regex": SPLIT}
        and pre[0]["invert"]
        and pre[0]["behavior"] == "Removed"
        and not pre[1]["add_prefix_space"]
        and not pre[1]["use_regex"]
        and model["type"] == "BPE"
        and not model["dropout"]
        and not model["unk_token"]
        and not model["ignore_merges"]
        and all(re.fullmatch(r"<\|\w+\|>", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"])
    )
    return spec if fits else None


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letter[b] for b in range(256)]


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo = Memo()
        self.spec = by_words(path)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.library = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        if self.spec:
            vocab, end = self.spec["model"]["vocab"], self.spec["model"]["end_of_word_suffix"] or ""
            both = [x if isinstance(x, list) else x.split(" ") for x in self.spec["model"]["merges"]]
            get = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in both], np.int64)
            self.pairs = Pairs(get[:, 0], get[:, 1], np.arange(len(get)), get[:, 2])
            self.inner, self.final = (np.array([vocab[x + y] for x in byte_letters()], np.int64) for y in ("", end))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.library(texts)] if texts else []

    def _parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts of words."""
        data = [p.encode() for p in parts]
        length = np.fromiter(map(len, data), np.int64, len(data))
        code = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[code]
        symbols[np.cumsum(length) - 1] = self.final[code[np.cumsum(length) - 1]]
        ids, n = merge(symbols, length, self.pairs)
        raw, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(n * 4)]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        blob = "\n".join(words)
        if PLAIN.fullmatch(blob) and "<|" not in blob and max(map(len, words), default=0) <= 1000:
            return self._plain(blob.lower().split("\n")) if words else []
        plain = [bool(PLAIN.fullmatch(w)) and "<|" not in w and len(w) <= 1000 for w in words]
        of_plain = iter(self._plain([w.lower() for w, x in zip(words, plain, strict=True) if x]))
        of_rest = iter(self._encoded([w for w, x in zip(words, plain, strict=True) if not x]))
        return [next(of_plain if x else of_rest) for x in plain]

    def _plain(self, words: list[str]) -> list[bytes]:
        """The ids of plain words in lower case."""
        distinct = set(words)
        parts = {w for w in distinct if w.isalpha()}
        joint = {w: PARTS.findall(w) for w in distinct - parts}
        for x in joint.values():
            parts.update(x)
        each = list(parts)
        ids = dict(zip(each, self._parts(each), strict=True)) if each else {}
        ids.update([(w, b"".join([ids[p] for p in x])) for w, x in joint.items()])
        return list(map(ids.__getitem__, words))

    def ids(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one batch of texts after the other (null: empty): all ids, and where each text's begin, with the end."""
        if not self.spec:
            for lo in range(0, len(column), 64):
                found = self._encoded([x or "" for x in column.slice(lo, 64).to_pylist()])
                yield np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *(len(x) // 4 for x in found)])
            return
        for t in texts(column):
            if b"<|" not in t.data.tobytes():  # which may begin a special token, in lower case only
                t.data = LOWER[t.data]
            raw = t.data.tobytes()

            def work_out(at: np.ndarray, t: Texts = t, raw: bytes = raw) -> tuple[np.ndarray, np.ndarray]:
                spans = zip(t.starts[at].tolist(), t.ends[at].tolist(), strict=True)
                ids = self._words([raw[a:b].decode() for a, b in spans])
                return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

            flat, n = self.memo.get(t.word_hashes(), t.data, t.starts, t.ends, work_out)
            yield flat, np.concatenate([[0], np.cumsum(n)])[t.first]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each file and Python worker, kept from task to task."""
    return Encoder(path)
