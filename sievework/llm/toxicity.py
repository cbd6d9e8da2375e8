"""Toxicity by bags of subwords.

A word is the mean of the vectors of its character n-grams (and of the word itself), hashed into a fixed number of
buckets, so that an unseen spelling shares vectors with those seen. A window of two words is the mean of their
vectors, and a linear softmax over the two labels reads it. A text's log-odds weigh those of its windows by their own
softmax, so that one bad passage in a long text is not averaged away. Vectors and softmax are trained jointly, in
numpy, on a bounded sample of labelled texts of any length. As the softmax is linear, scoring needs only each bucket's vector times
the difference of the two weight vectors: one number for each bucket.

Cases: a null or empty text gets the log-odds of no window, the bias alone; labels that are null are left out; of
contradictory labels of one document the toxic one holds; without labelled texts of both kinds nothing is learned and
every score is that of the bias, below one half; repeated rows score alike, and a score at the threshold counts as toxic; an
empty table gives an empty result; columns may have any other names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, shared
from .text import mixed

WINDOW, STEP = 2, 1
PRIOR = -3.0


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 3 to 5 characters of <word>, and of each whole word; and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(length)
    left = np.repeat(end, length) - np.arange(len(code))  # characters from here to the word's end
    of = np.repeat(np.arange(len(words)), length)
    found, owners = [], []
    with np.errstate(over="ignore"):
        rolling = code * np.uint64(0x9E3779B97F4A7C15)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(code + np.uint64(1)) * (np.arange(len(code)) - np.repeat(end - length, length) + 1).astype(np.uint64))])
        found.append(mixed(sums[end] - sums[end - length]))
        owners.append(np.arange(len(words)))
        for n in range(2, 6):
            rolling = mixed(rolling[:-1]) + code[n - 1 :] if len(rolling) > 1 else rolling[:0]
            if n > 2:
                ok = left[: len(rolling)] >= n
                found.append(mixed(rolling[ok] + np.uint64(n)))
                owners.append(of[: len(rolling)][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(words))


def all_subwords(words: list[str], buckets: int, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """subwords, some words at a time."""
    parts = [subwords(words[i : i + at_once], buckets) for i in range(0, len(words), at_once)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([g.astype(np.int32) for g, _ in parts]), np.concatenate([n for _, n in parts])


def split(text: str) -> list[str]:
    return [w.strip(".,;:!?\"'()") for w in text.lower().split()]


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows over n words begin and end."""
    lo = np.arange(0, max(1, n - STEP), STEP)
    return lo, np.minimum(lo + WINDOW, n)


def pooled(z: np.ndarray) -> tuple[float, np.ndarray]:
    """The text's log-odds and the windows' weights in it."""
    p = np.exp(z - z.max())
    p /= p.sum()
    return float(p @ z), p


@dataclass
class Model:
    """score: for each bucket, its vector times the softmax's difference of weights."""

    score: np.ndarray
    bias: float
    most_words: int = 60_000

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        grams, n = subwords(words, len(self.score))
        return np.add.reduceat(self.score[grams], np.cumsum(n) - n) / n if words else np.zeros(0)

    def log_odds(self, texts: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self.most_words:
            known.clear()
        split_texts = [split(t) for t in texts]
        new = list({w for words in split_texts for w in words}.difference(known))
        for i in range(0, len(new), 5_000):
            known.update(zip(new[i : i + 5_000], self.word_scores(new[i : i + 5_000]).tolist(), strict=True))
        out = np.full(len(texts), self.bias)
        for i, words in enumerate(split_texts):
            if words:
                sums = np.zeros(len(words) + 1)
                np.cumsum(np.fromiter(map(known.__getitem__, words), float, len(words)), out=sums[1:])
                lo, hi = windows(len(words))
                out[i] = self.bias + pooled((sums[hi] - sums[lo]) / (hi - lo))[0]
        return out


def train(
    texts: list[str], labels: np.ndarray, buckets: int = 1 << 17, dim: int = 8, epochs: int = 5, least_steps: int = 600, batch: int = 32, rate: float = 1.0, seed: int = 7
) -> Model:
    """Adagrad on the log-loss of the texts' log-odds, by bucket vectors E and softmax weights U and biases b.

    There are at least ``least_steps`` steps, so that few texts are gone over more often."""
    rng = np.random.Generator(np.random.PCG64(seed))
    labels = np.asarray(labels, float)
    if not len(texts) or not 0 < labels.sum() < len(labels):
        return Model(np.zeros(buckets, np.float32), PRIOR)
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in split(t)), np.int64) for t in texts]
    grams, n = all_subwords(list(number), buckets)
    at = np.concatenate([[0], np.cumsum(n)])
    E = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    U = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    b = np.array([0.0, PRIOR])
    sq_e, sq_u, sq_b = np.full(buckets, 1e-6), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    epochs = max(epochs, -(-least_steps * batch // len(texts)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for lo_ in range(0, len(order), batch):
            docs = [i for i in order[lo_ : lo_ + batch] if len(ids[i])]
            if not docs:
                continue
            words, inverse = np.unique(np.concatenate([ids[i] for i in docs]), return_inverse=True)
            size = n[words]
            flat = np.repeat(at[words] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            g, owner = grams[flat], np.repeat(np.arange(len(words)), size)
            vectors = np.add.reduceat(E[g], np.cumsum(size) - size, axis=0) / size[:, None]
            u = U[:, 1] - U[:, 0]
            s = vectors @ u
            slope_w, slope_b, k = np.zeros(len(words)), 0.0, 0
            for i in docs:
                mine = inverse[k : k + len(ids[i])]
                k += len(ids[i])
                sums = np.concatenate([[0.0], np.cumsum(s[mine])])
                lo, hi = windows(len(mine))
                z, p = pooled((sums[hi] - sums[lo]) / (hi - lo))
                error = 1 / (1 + np.exp(-(z + b[1] - b[0]))) - labels[i]
                each = error * p / (hi - lo)
                edge = np.zeros(len(mine) + 1)
                np.add.at(edge, lo, each)
                np.add.at(edge, hi, -each)
                slope_w += np.bincount(mine, np.cumsum(edge)[:-1], len(words))
                slope_b += error
            slope_w /= len(docs)
            slope_b /= len(docs)
            touched, where = np.unique(g, return_inverse=True)
            slope_g = np.bincount(where, (slope_w / size)[owner], len(touched))
            slope_u = vectors.T @ slope_w
            sq_e[touched] += slope_g**2 * (u @ u)
            E[touched] -= (step * slope_g / np.sqrt(sq_e[touched]))[:, None] * u
            slope_u2 = np.stack([-slope_u, slope_u], 1)
            sq_u += slope_u2**2
            U -= (step * slope_u2 / np.sqrt(sq_u)).astype(np.float32)
            slope_b2 = np.array([-slope_b, slope_b])
            sq_b += slope_b2**2
            b -= 0.2 * step * slope_b2 / np.sqrt(sq_b)
    return Model((E @ (U[:, 1] - U[:, 0])).astype(np.float32), float(b[1] - b[0]))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 3500, most_bytes: int = 16 << 20, **how) -> Model:
    """Trains on at most so many labelled texts of each kind, and so many bytes of each, as labelled.sample() takes them."""
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    marked = marked.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("mark"))
    rows = labelled.sample(docs, marked, {1: positives, 0: negatives}, most_bytes).toArrow()
    rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))
    return train(rows["text"].to_pylist(), rows["mark"].to_numpy(), **how)


def scorer(model: Model):
    """A column expression: texts to scores from 0 to 1."""

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for lo in range(0, len(column), 32):
            z = model.log_odds([x or "" for x in column.slice(lo, 32).to_pylist()])
            out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        return pa.array(np.concatenate(out))

    return score


def rated(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    score = scorer(fit(docs, labels, **how))
    return docs.select("doc_id", held_out().alias("held_out"), score(shared.whole_text()).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def passing(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns only."""
    (name,) = shared.unused(docs.columns, "score")
    score = scorer(fit(docs, labels, **how))
    return docs.withColumn(name, score(shared.whole_text())).where(F.col(name) < threshold).select(*shared.own_columns(docs))
