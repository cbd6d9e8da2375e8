"""Ordinal regression of graded ratings by a cumulative-link model on hashed text.

All grades share one weight vector over hashed features; ordered thresholds cut its score into grades:
P(grade > k) = 1 / (1 + exp(theta_k - score)). The expected grade is the sum of these probabilities, and the tail
probability that of a grade that is good enough.

Features of a text are its hashed runs of four bytes, in lower case and as they are: the square root of how often a bucket
occurs, times the bucket's rarity in the sample that the model is fitted on, scaled to length 1, so that a few rare runs show
in a long text. Beside them are the square roots of the shares of repeated words, words that follow themselves, and capitals.

The model is fitted on a bounded sample of rated texts of any length, the same for every run, by a hash of doc_id.

Cases: a null or empty text has no features, and its score is the bias alone; null ratings and grades outside
0 to top are left out; of several ratings of a document the lowest holds; without ratings of two grades at least nothing
is learned and all texts get the same score, at which everything is kept; rows may repeat; a probability at the limit is kept; an empty
table gives an empty result; columns may have any other names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, shared
from .quality_rules import keyed
from .text import LOWER, Texts, texts

BITS = 13
BUCKETS = 1 << BITS
EXTRA = 3
#: Texts handled at once.
AT_ONCE = 64


def counts(t: Texts) -> np.ndarray:
    """How often each text has each bucket's runs of four bytes: a row for each text."""
    n = len(t.data) - 3
    if n <= 0:
        return np.zeros((len(t), BUCKETS), np.float32)
    low = LOWER[t.data]
    capital = (low != t.data).astype(np.uint32)
    x, shape = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(4):
        x |= low[k : k + n].astype(np.uint32) << np.uint32(8 * k)
        shape |= capital[k : k + n] << np.uint32(k)
    with np.errstate(over="ignore"):
        h = (x ^ (shape * np.uint32(0x85EBCA6B))) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    of = np.repeat(np.arange(len(t)), np.diff(t.offsets))
    inside = of[:n] == of[3:]
    bucket = (h[inside] >> np.uint32(32 - BITS)).astype(np.int64)
    return np.bincount(of[:n][inside] * BUCKETS + bucket, minlength=len(t) * BUCKETS).reshape(len(t), BUCKETS).astype(np.float32)


def extras(t: Texts) -> np.ndarray:
    """Shares of words that equal the one before, of words that the text has again, and of capitals."""
    h, n = t.word_hashes(), np.maximum(t.n_words, 1)
    of = np.repeat(np.arange(len(t)), t.n_words)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    keys = keyed(h, of)
    first = np.zeros(len(h), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    capital = t.bytes_per_text((t.data >= 65) & (t.data <= 90)) / np.maximum(np.diff(t.offsets), 1)
    return np.stack([t.per_text(again) / n, t.per_text(~first) / n, capital], 1)


def in_parts(column: pa.Array):
    """The column's texts, AT_ONCE at most at a time."""
    for lo in range(0, len(column), AT_ONCE):
        yield from texts(column.slice(lo, AT_ONCE))


@dataclass
class Rows:
    """Features of some texts: values of buckets, each with the number of its text, in order, and the other columns."""

    bucket: np.ndarray
    value: np.ndarray
    owner: np.ndarray
    extra: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.value * w[:BUCKETS][self.bucket], len(self.extra)) + self.extra @ w[BUCKETS:]

    def weighed(self, g: np.ndarray) -> np.ndarray:
        """The sum of the texts' features, each text's times its g."""
        return np.concatenate([np.bincount(self.bucket, self.value * g[self.owner], BUCKETS), g @ self.extra])


@dataclass
class Model:
    """weights of the features, the rarity of each bucket, and ordered thresholds theta_0 < theta_1 < ..."""

    weights: np.ndarray
    rarity: np.ndarray
    theta: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        w, square = (self.weights[:BUCKETS] * self.rarity).astype(np.float32), (self.rarity**2).astype(np.float32)
        out = [np.zeros(0)]
        for t in in_parts(column):
            c = counts(t)
            length = np.sqrt(np.maximum(c @ square, 1e-12))
            out.append((np.sqrt(c) @ w) / length + np.sqrt(extras(t)) @ self.weights[BUCKETS:])
        return np.concatenate(out)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return 1 / (1 + np.exp(np.clip(self.theta[None] - scores[:, None], -500, 500)))


def thresholds(theta0: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A first threshold and the logarithms of the steps to the next ones, as thresholds."""
    return np.concatenate([theta0, theta0 + np.cumsum(np.exp(steps))])


def loss_and_slopes(x: Rows, grade: np.ndarray, w: np.ndarray, theta0: np.ndarray, steps: np.ndarray, ridge: float) -> tuple[float, list[np.ndarray]]:
    """The mean log-loss with a ridge on w, and its slopes by w, theta0 and steps."""
    z, n, top, rows = x.times(w), len(grade), len(steps) + 1, np.arange(len(grade))
    # P(grade = g) = F(theta_g - z) - F(theta_{g-1} - z), with -inf and inf at the ends
    edges = np.concatenate([[-np.inf], thresholds(theta0, steps), [np.inf]])
    with np.errstate(over="ignore"):
        cdf = 1 / (1 + np.exp(-(edges[None] - z[:, None])))
    density = cdf * (1 - cdf)
    p = (cdf[rows, grade + 1] - cdf[rows, grade]).clip(1e-12)
    up, low = density[rows, grade + 1] / p, density[rows, grade] / p
    g_edge = np.zeros(top + 2)
    np.add.at(g_edge, grade + 1, -up / n)
    np.add.at(g_edge, grade, low / n)
    g_theta = g_edge[1:-1]
    g_steps = np.array([g_theta[k + 1 :].sum() * np.exp(steps[k]) for k in range(top - 1)])
    return float(-np.log(p).mean() + ridge * w @ w), [x.weighed((up - low) / n) + 2 * ridge * w, np.array([g_theta.sum()]), g_steps]


def train(x: Rows, rarity: np.ndarray, grade: np.ndarray, top: int, rounds: int = 120, ridge: float = 1e-5, rate: float = 0.3) -> Model:
    """Adam on the mean log-loss of the grades."""
    w = np.zeros(BUCKETS + x.extra.shape[1])
    if len(np.unique(grade)) < 2:
        return Model(w, rarity, np.linspace(-6, -5, top))
    count = np.array([(grade > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(1 / count - 1) + 1e-3 * np.arange(top))
    theta0, steps = start[:1].copy(), np.log(np.diff(start).clip(1e-3))
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, theta0, steps)]
    for r in range(1, rounds + 1):
        _, slopes = loss_and_slopes(x, grade, w, theta0, steps, ridge)
        for v, g, (m, s) in zip((w, theta0, steps), slopes, moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g**2 - s)
            v -= rate * (1 - r / (rounds + 1)) * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-10)
    return Model(w, rarity, thresholds(theta0, steps))


def scaled(bucket: list[np.ndarray], count: list[np.ndarray], extra: np.ndarray) -> tuple[Rows, np.ndarray]:
    """The features of texts from their counts, and the rarity of each bucket: log of 1 + texts over 1 + texts that have it."""
    n = len(bucket)
    owner = np.repeat(np.arange(n), [len(b) for b in bucket])
    bucket, count = (np.concatenate(x) if x else np.zeros(0) for x in (bucket, count))
    bucket = bucket.astype(np.int32)
    rarity = np.log((1 + n) / (1 + np.bincount(bucket, minlength=BUCKETS))) + 0.1
    value = (np.sqrt(count) * rarity[bucket]).astype(np.float32)
    length = np.sqrt(np.bincount(owner, value.astype(float) ** 2, n))
    return Rows(bucket, value / np.maximum(length, 1e-6)[owner].astype(np.float32), owner, extra), rarity


def fit(docs: DataFrame, ratings: DataFrame, top: int, per_grade: int = 1500, most_bytes: int = 6 << 20) -> Model:
    """ratings: doc_id and grade, 0 to top. Of each grade at most so many texts and bytes, as labelled.sample() takes them."""
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, top))
    rated = rated.groupBy(F.col("doc_id").alias("id")).agg(F.min("grade").cast("int").alias("mark"))
    chosen = labelled.sample(docs, rated, dict.fromkeys(range(top + 1), per_grade), most_bytes)

    def counted(batches):
        for batch in batches:
            rows = []
            for t in in_parts(batch.column(2)):
                for c, e in zip(counts(t), extras(t), strict=True):
                    bucket = np.flatnonzero(c)
                    rows.append((bucket.astype(np.uint32).tobytes(), c[bucket].tobytes(), np.sqrt(e).tobytes()))
            columns = [pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "grade", "bucket", "count", "extra"])

    rows = chosen.select("id", "mark", "text").mapInArrow(counted, "id long, grade int, bucket binary, count binary, extra binary").toArrow()
    rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))
    bucket, count = ([np.frombuffer(x, kind) for x in rows[c].to_pylist()] for c, kind in (("bucket", np.uint32), ("count", np.float32)))
    extra = np.frombuffer(b"".join(rows["extra"].to_pylist()), float).reshape(-1, EXTRA)
    return train(*scaled(bucket, count, extra), rows["grade"].to_numpy().astype(int), top)


def rated(docs: DataFrame, ratings: DataFrame, top: int = 2, least: int = 1, keep: float = 0.3, **how) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of ``least`` or more) and kept (where that is ``keep`` or more)."""
    model = fit(docs, ratings, top, **how)
    kind = T.StructType([T.StructField(x, T.DoubleType()) for x in ("expected_grade", "tail_probability")])

    @F.arrow_udf(kind)
    def graded(column: pa.Array) -> pa.Array:
        above = model.above(model.scores(column))
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, least - 1])], kind.names)

    return docs.select("doc_id", graded(shared.whole_text()).alias("g")).select(
        "doc_id", "g.expected_grade", "g.tail_probability", (F.col("g.tail_probability") >= keep).alias("kept")
    )


def grades(labels: DataFrame) -> DataFrame:
    """Ratings of three grades from two marks: 0 for poor text, 1 for good text that is toxic, 2 for good text."""
    quality, toxic = F.col("quality"), F.col("toxic")
    grade: Column = F.when(quality == 0, 0).when(toxic == 1, 1).when(toxic == 0, 2)
    return labels.select("doc_id", grade.alias("grade"))
