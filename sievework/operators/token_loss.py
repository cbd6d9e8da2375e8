"""Mean loss of tokens under an n-gram language model, for samples that are token arrays and not vectors.

The model's counts are tables. Levels of 1 to ``order`` tokens are interpolated after Witten and Bell: a gram of context h and token w has

    p(w | h) = (count(h w) + followers(h) p(w | shorter h)) / (count(h) + followers(h)),

where the shortest level falls back on 1 / vocabulary, and a context that was never seen on the next shorter one. The token at each place but the
first is predicted from those before it, if its label is not -100.

A gram is one number, ``bits`` for each token, so lower levels are its low bits and contexts its high bits. Tasks count grams before they are
shuffled. A probability is worked out once for each distinct gram that is asked for, level by level by joins on grams and contexts; then
each sample's grams, counted within the sample, meet them. Grams of which a sample in ten thousand or more has one are at most as many as
fit a broadcast; all others meet by a shuffle.

Cases: null arrays count as empty; a sample without a predicted token has a null loss and 0 tokens; a null label is left out as -100 is; ids
below 0 or beyond the vocabulary are an error; rows of one id count as one sample; a model of no rows gives 1 / vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import IGNORE
from ..sources.tables import written

#: Tokens of a batch that are handled at once, but for a row that is longer.
TOKENS = 200_000
#: Grams that a task counts before it gives its counts away; the grams that are told to all; and the places of hot grams that make it worth while.
AT_ONCE, MOST_SENT, OFTEN = 1_000_000, 10_000, 1000


@dataclass(frozen=True)
class Coding:
    """Grams of ``order`` tokens as numbers."""

    order: int = 3
    vocabulary: int = 32_000

    def __post_init__(self) -> None:
        if self.order < 1 or self.order * self.bits > 62:
            raise ValueError(f"{self.order} tokens of {self.bits} bits do not fit a number of 62")

    @property
    def bits(self) -> int:
        return self.vocabulary.bit_length()  # the vocabulary's size itself stands for what is before the first token

    def mask(self, k: int) -> int:
        return (1 << self.bits * k) - 1

    def grams(self, ids: pa.Array, labels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The grams of all predicted places of a batch, and the row that each is in."""
        x, row, place = flat(ids)
        y, row_y, _ = flat(labels)
        if len(x) != len(y) or (row != row_y).any():
            raise ValueError("input_ids and labels differ in length")
        if len(x) and not 0 <= x.min() <= x.max() < self.vocabulary:
            raise ValueError(f"token ids must lie between 0 and {self.vocabulary - 1}")
        gram = np.zeros(len(x), np.int64)
        for back in range(self.order - 1, 0, -1):
            before = np.full(len(x), self.vocabulary, np.int64)
            there = np.flatnonzero(place >= back)
            before[there] = x[there - back]
            gram = gram << self.bits | before
        told = (place > 0) & (y != IGNORE)
        if told.any() and not 0 <= y[told].min() <= y[told].max() < self.vocabulary:
            raise ValueError(f"labels must lie between 0 and {self.vocabulary - 1}")
        return (gram << self.bits | y)[told], row[told]


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of TOKENS or one row: a batch has 10,000 rows, and each token is held a dozen times over as a number of 64 bits."""
    for b in batches:
        ends, lo = np.cumsum(b.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of a column of arrays, the row that each is in, and its place there. A null number is IGNORE."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    values = (values.fill_null(IGNORE) if values.null_count else values).to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)


def gram_counts(tokens: DataFrame, coding: Coding) -> DataFrame:
    """gram and cnt of all predicted places; tokens has input_ids and labels."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def tally() -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([c for _, c in held]), len(grams)).astype(np.int64)

        for b in slices(batches, 0):
            held.append(np.unique(coding.grams(b.column(0), b.column(1))[0], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * AT_ONCE:
                grams, cnt = tally()
                if len(grams) > AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(cnt)], ["gram", "cnt"])
                    grams, cnt = grams[:0], cnt[:0]
                held, size = [(grams, cnt)], len(grams)
        if held:
            grams, cnt = tally()
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(cnt)], ["gram", "cnt"])

    return tokens.select("input_ids", "labels").mapInArrow(run, "gram long, cnt long").groupBy("gram").agg(F.sum("cnt").alias("cnt"))


@dataclass(frozen=True)
class Model:
    """counts: gram and cnt at the highest level, a table; the lower levels are sums of it."""

    counts: DataFrame
    coding: Coding

    def level(self, k: int) -> tuple[DataFrame, DataFrame]:
        """gram and cnt of k tokens, and context, total and followers."""
        low = self.counts.select(F.col("gram").bitwiseAND(F.lit(self.coding.mask(k))).alias("gram"), "cnt")
        grams = low.groupBy("gram").agg(F.sum("cnt").alias("cnt")) if k < self.coding.order else self.counts
        context = F.shiftright("gram", self.coding.bits).alias("context")
        return grams, grams.groupBy(context).agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("followers"))


def fit(tokens: DataFrame, order: int = 3, vocabulary: int = 32_000) -> Model:
    """A model of the predicted places of tokens (input_ids and labels). Its counts are written once."""
    coding = Coding(order, vocabulary)
    return Model(written(gram_counts(tokens, coding), "grams"), coding)


def probabilities(model: Model, grams: DataFrame) -> DataFrame:
    """gram and p of each distinct gram."""
    coding = model.coding
    low = lambda c, k: F.col(c).bitwiseAND(F.lit(coding.mask(k)))
    known = None
    for k in range(1, coding.order + 1):
        asked = grams.select(low("gram", k).alias("gram")).distinct()
        seen, contexts = model.level(k)
        rows = asked.join(seen, "gram", "left").withColumn("context", F.shiftright("gram", coding.bits))
        rows = rows.join(F.broadcast(contexts) if k == 1 else contexts, "context", "left")  # one context, the empty one
        if known is None:
            rows = rows.withColumn("shorter", F.lit(1 / coding.vocabulary))
        else:
            rows = rows.withColumn("low", low("gram", k - 1)).join(known.select(F.col("gram").alias("low"), F.col("p").alias("shorter")), "low")
        met = (F.coalesce("cnt", F.lit(0)) + F.col("followers") * F.col("shorter")) / (F.col("total") + F.col("followers"))
        known = rows.select("gram", F.coalesce(met, "shorter").alias("p"))
    return known


def sample_grams(tokens: DataFrame, id_col: str, coding: Coding) -> DataFrame:
    """id, gram and times: how often each sample has each gram."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, 1):
            gram, row = coding.grams(b.column(1), b.column(2))
            order = np.lexsort((gram, row))
            gram, row = gram[order], row[order]
            first = np.ones(len(gram), bool)
            first[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            times = np.diff(np.append(at, len(gram)))
            for lo in range(0, len(at), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at[part]])), pa.array(gram[at[part]]), pa.array(times[part])], [id_col, "gram", "times"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col), "input_ids", "labels").mapInArrow(run, f"{id_col} {kind}, gram long, times long")


def token_losses(tokens: DataFrame, id_col: str, model: Model) -> DataFrame:
    """id, loss (the mean of -ln p over the sample's predicted places) and tokens, how many these are."""
    each = written(sample_grams(tokens, id_col, model.coding), "sample-grams")
    known = written(probabilities(model, each.select("gram").distinct()), "probabilities")
    often = max(OFTEN, each.count() // MOST_SENT)
    hot = F.broadcast(each.groupBy("gram").count().where(F.col("count") > often).select("gram").join(known, "gram"))
    rows = each.join(hot, "gram").unionByName(each.join(hot.select("gram"), "gram", "left_anti").join(known, "gram"))
    sums = rows.groupBy(id_col).agg(F.sum(F.col("times") * -F.ln("p")).alias("__loss"), F.sum("times").alias("__n"))
    ids = tokens.select(id_col).distinct()
    return ids.join(sums, id_col, "left").select(id_col, (F.col("__loss") / F.col("__n")).alias("loss"), F.coalesce("__n", F.lit(0)).alias("tokens"))
