"""Scores of samples by a model's gradients, and what follows from them.

The model behind the scores is a plug-in: a scorer gives, for each sample and checkpoint, loss and gradient in Arrow
batches, and only numbers leave the batch, never gradients. SoftmaxScorer is the one built in: multinomial logistic
regression on a vector column, whose gradient (p - y) x^T has the squared norm |p - y|^2 |x|^2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .array_sums import added
from .scalars import beside


@dataclass(frozen=True)
class Checkpoint:
    step: int
    lr: float
    params: np.ndarray


class Scorer(Protocol):
    """Of a batch of samples at a checkpoint: the losses, and the gradients as (left, right), whose outer products they are."""

    columns: Sequence[str]

    def __call__(self, batch: pa.RecordBatch, checkpoint: Checkpoint) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...


@dataclass(frozen=True)
class SoftmaxScorer:
    """params: a row of weights for each class, classes being 0, 1, 2 ..."""

    vector: str = "embedding"
    label: str = "label"

    @property
    def columns(self) -> tuple[str, str]:
        return self.vector, self.label

    def __call__(self, batch, checkpoint):
        x = np.array(batch.column(self.vector).to_pylist(), float).reshape(batch.num_rows, -1)
        y = np.array(batch.column(self.label).to_pylist(), int)
        z = x @ checkpoint.params.T
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        at = np.arange(len(y)), y
        loss = -np.log(np.maximum(p[at], 1e-300))
        p[at] -= 1
        return loss, p, x


def rates(checkpoints: Sequence[Checkpoint], given: bool = False) -> dict[int, float]:
    """The weight of each checkpoint: its learning rate over the sum of all where they are given, else one share each."""
    if given:
        total = sum(c.lr for c in checkpoints)
        return {c.step: c.lr / total for c in checkpoints}
    return {c.step: 1 / len(checkpoints) for c in checkpoints}


def gradient_norms(df: DataFrame, id_col: str, scorer: Scorer, checkpoints: Sequence[Checkpoint]) -> DataFrame:
    """id, step, loss and norm2, the squared norm of the gradient, for each sample and checkpoint."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for c in checkpoints:
                loss, left, right = scorer(b, c)
                norm2 = (left**2).sum(1) * (right**2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(np.full(len(loss), c.step)), pa.array(loss), pa.array(norm2)], [id_col, "step", "loss", "norm2"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("__id"), *scorer.columns).mapInArrow(run, f"{id_col} {kind}, step long, loss double, norm2 double")


def self_influence(df: DataFrame, id_col: str, scorer: Scorer, checkpoints: Sequence[Checkpoint], given_rates: bool = False) -> DataFrame:
    """id and score: the sum over checkpoints of rate times the squared norm of the gradient."""
    weight = rates(checkpoints, given_rates)
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in weight.items() for x in pair]), F.col("step").cast("int"))
    return gradient_norms(df, id_col, scorer, checkpoints).groupBy(id_col).agg(F.sum(rate * F.col("norm2")).alias("score"))


#: Columns of a gradient's right side in a block, and bytes of gradients that a task holds.
WIDTH, MOST_HELD = 1024, 1 << 26


def sides(df: DataFrame, scorer: Scorer, checkpoint: Checkpoint) -> tuple[int, int]:
    """How many rows and columns a gradient has; none of an empty table."""
    some = df.select(*scorer.columns).limit(1).toArrow().to_batches()
    if not sum(b.num_rows for b in some):
        return 0, 0
    _, left, right = scorer(next(b for b in some if b.num_rows), checkpoint)
    return left.shape[1], right.shape[1]


def numbers(n: int) -> Column:
    """0 to n - 1."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def in_groups(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of equal values of some columns of numbers."""
    values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for v in values:
        change[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(change)
    for lo, hi in zip(at, np.append(at[1:], batch.num_rows), strict=True):
        yield tuple(v[lo] for v in values), batch.slice(lo, hi - lo)


def mean_gradients(df: DataFrame, dim: str, scorer: Scorer, checkpoints: Sequence[Checkpoint], width: int = WIDTH, most_held: int = MOST_HELD) -> DataFrame:
    """step, dim, block, n and gradient: the mean gradient of the n samples of each dimension at each checkpoint, in blocks of ``width`` columns,
    each a flat array.

    A task sums up a group of blocks that fits in memory over all its samples, and gives each block away once. Where one group is not all blocks,
    samples are dealt to each group. Partial sums of a block meet in one task, one after the other.
    """
    rows, columns = sides(df, scorer, checkpoints[0])
    blocks = -(-columns // width)
    n_dims = df.select(dim).distinct().count()
    at_once = max(1, most_held // max(1, 8 * rows * width * len(checkpoints) * n_dims))
    groups = -(-blocks // at_once)

    def run(batches):
        n: dict[tuple, int] = {}
        total: dict[tuple, np.ndarray] = {}
        group = None

        def give():
            for key, x in total.items():
                step, d, block = key
                yield pa.RecordBatch.from_arrays(
                    [pa.array([step]), pa.array([d], pa.string()), pa.array([block]), pa.array([float(n[key])]), pa.array([x.ravel().tolist()], pa.list_(pa.float64()))], ["step", "dim", "block", "n", "total"]
                )
            n.clear()
            total.clear()

        for b in batches:
            for (g,), part in in_groups(b, "__group"):
                if g != group:
                    yield from give()
                    group = g
                names = np.array(part.column("__dim").to_pylist(), object)
                for c in checkpoints:
                    _, left, right = scorer(part, c)
                    for d in pd.unique(names):
                        at = names == d
                        for block in range(int(g) * at_once, min((int(g) + 1) * at_once, blocks)):
                            key = c.step, d, block
                            total[key] = total.get(key, 0.0) + left[at].T @ right[at, block * width : (block + 1) * width]
                            n[key] = n.get(key, 0) + int(at.sum())
        yield from give()

    dealt = df.select(F.col(dim).cast("string").alias("__dim"), F.explode(numbers(max(groups, 1))).alias("__group"), *scorer.columns)
    if groups > 1:
        dealt = dealt.repartition("__group", F.pmod(F.hash(*scorer.columns), F.lit(64))).sortWithinPartitions("__group")
    sums = added(dealt.mapInArrow(run, "step long, dim string, block long, n double, total array<double>"), ["step", "dim", "block"])
    return sums.select("step", "dim", "block", F.col("n").cast("long").alias("n"), F.transform("total", lambda x: x / F.col("n")).alias("gradient"))


def gradient_norms_of(gradients: DataFrame) -> DataFrame:
    """step, dim, size and norm of the gradients that mean_gradients() gives."""
    square = F.aggregate("gradient", F.lit(0.0), lambda s, x: s + x * x)
    return gradients.groupBy("step", "dim").agg(F.sum(F.size("gradient")).cast("long").alias("size"), F.sqrt(F.sum(square)).alias("norm"))


def validation_influence(
    df: DataFrame,
    id_col: str,
    scorer: Scorer,
    checkpoints: Sequence[Checkpoint],
    gradients: DataFrame,
    normalize: bool = True,
    given_rates: bool = False,
    per_bucket: int = 200_000,
    most_held: int = MOST_HELD,
) -> DataFrame:
    """id, dim and score: the sum over checkpoints of rate times the (cosine of the) inner product with the dimension's mean gradient.

    gradients has the blocks that mean_gradients() gives. A task holds a group of blocks that fits in memory, of all checkpoints and dimensions, and a bucket of
    samples passes by them, batch by batch; so blocks are sent once for each bucket, samples once for each group, and neither reaches the
    driver. What a sample has with each group is added up by its id, so ids are unique.
    """
    gradients = written(gradients, "gradients")
    norms = {(r["step"], r["dim"]): r["norm"] for r in gradient_norms_of(gradients).collect()}
    names, weight = sorted({d for _, d in norms}), rates(checkpoints, given_rates)
    kind = df.schema[id_col].dataType.simpleString()
    if not names:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, dim string, score double")
    rows, _ = sides(df, scorer, checkpoints[0])
    ends = gradients.agg(F.max("block").alias("last"), F.max(F.size("gradient")).alias("size")).first()
    width = ends["size"] // max(rows, 1)
    at_once = max(1, most_held // max(1, 8 * ends["size"] * len(norms)))
    groups, buckets = ends["last"] // at_once + 1, -(-df.count() // per_bucket) or 1
    place = {key: k for k, key in enumerate((c.step, d) for c in checkpoints for d in names)}

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        where = None
        for b in batches:
            for (group, bucket, sample), part in in_groups(b, "__group", "__bucket", "__sample"):
                if where != (group, bucket):
                    held, where = {}, (group, bucket)
                if not sample:
                    for i in range(part.num_rows):
                        key = part.column("__step")[i].as_py(), part.column("__dim")[i].as_py()
                        if key in place:
                            held[place[key], part.column("__block")[i].as_py()] = part.column("__gradient")[i].values.to_numpy(zero_copy_only=False).reshape(rows, -1)
                    continue
                inner, own = np.zeros((part.num_rows, len(place))), np.zeros((part.num_rows, len(checkpoints)))
                for i, c in enumerate(checkpoints):
                    _, left, right = scorer(part, c)
                    if group == 0:
                        own[:, i] = np.sqrt((left**2).sum(1) * (right**2).sum(1))
                    for (k, block), g in held.items():
                        if i * len(names) <= k < (i + 1) * len(names):
                            inner[:, k] += np.einsum("ij,ij->i", left @ g, right[:, block * width : block * width + g.shape[1]])
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (inner, own)]
                yield pa.RecordBatch.from_arrays([part.column("__id"), *lists], ["__id", "inner", "own"])

    none = lambda t: F.lit(None).cast(t)
    samples = df.select(
        F.explode(numbers(groups)).alias("__group"), F.pmod(F.xxhash64(id_col), F.lit(buckets)).alias("__bucket"), F.lit(1).alias("__sample"),
        none("long").alias("__step"), none("string").alias("__dim"), none("long").alias("__block"), none("array<double>").alias("__gradient"), F.col(id_col).alias("__id"), *scorer.columns,
    )
    blocks = gradients.select(
        F.floor(F.col("block") / at_once).alias("__group"), F.explode(numbers(buckets)).alias("__bucket"), F.lit(0).alias("__sample"),
        F.col("step").alias("__step"), F.col("dim").alias("__dim"), F.col("block").alias("__block"), F.col("gradient").alias("__gradient"), none(kind).alias("__id"),
        *[none(df.schema[c].dataType.simpleString()).alias(c) for c in scorer.columns],
    )
    met = blocks.unionByName(samples).repartition("__group", "__bucket").sortWithinPartitions("__group", "__bucket", "__sample")
    found = met.mapInArrow(run, f"__id {kind}, inner array<double>, own array<double>")
    if groups > 1:
        sums = [F.sum(F.get("inner", F.lit(k))).alias(f"i{k}") for k in range(len(place))] + [F.sum(F.get("own", F.lit(i))).alias(f"o{i}") for i in range(len(checkpoints))]
        found = found.groupBy("__id").agg(*sums)
    else:
        found = found.select("__id", *[F.get("inner", F.lit(k)).alias(f"i{k}") for k in range(len(place))], *[F.get("own", F.lit(i)).alias(f"o{i}") for i in range(len(checkpoints))])
    least = lambda x: F.greatest(x, F.lit(1e-12))

    def score(d: str) -> Column:
        out = F.lit(0.0)
        for i, c in enumerate(checkpoints):
            inner = F.col(f"i{place[c.step, d]}")
            out = out + F.lit(weight[c.step]) * (inner / (least(F.col(f"o{i}")) * F.lit(max(norms.get((c.step, d), 0.0), 1e-12))) if normalize else inner)
        return out

    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), score(d).alias("score")) for d in names])).alias("x")
    return found.select(F.col("__id").alias(id_col), each).select(id_col, "x.dim", "x.score")


def multi_objective(scores: DataFrame, id_col: str, lambdas: dict[str, float]) -> DataFrame:
    """id, a column <dim>_score for each dimension of lambdas, and total_score, the weighted sum; a dimension without a lambda counts 0."""
    each = [F.max(F.when(F.col("dim") == d, F.col("score"))).alias(f"{d}_score") for d in lambdas]
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in lambdas.items() for x in p]), F.col("dim")), F.lit(0.0)) if lambdas else F.lit(0.0)
    return scores.groupBy(id_col).agg(*each, F.sum(weight * F.col("score")).alias("total_score"))


def summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean, population deviation, ends, and the shares above and below 0."""
    c = F.col(score)
    return scores.agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.avg((c > 0).cast("double")).alias("positive"), F.avg((c < 0).cast("double")).alias("negative"),
    )


def classify(score, threshold: float = 0.05):
    """proponent above the threshold, opponent below its negative, else neutral."""
    return F.when(score > threshold, "proponent").when(score < -threshold, "opponent").otherwise("neutral")


def initial_weights(labelled: DataFrame, id_col: str, score: str, label: str) -> DataFrame:
    """Weights of mean 1: 1 + score for proponents, that but 0.01 at least for opponents, 1 for others; over their mean."""
    s = F.col(score)
    raw = F.when(F.col(label) == "proponent", 1 + s).when(F.col(label) == "opponent", F.greatest(F.lit(0.01), 1 + s)).otherwise(1.0)
    rows = labelled.select(id_col, label, raw.alias("w"))
    return beside(rows, rows.agg(F.avg("w").alias("mean"))).select(id_col, label, (F.col("w") / F.col("mean")).alias("weight"))


def reweighted(weights: DataFrame, id_col: str, label: str, round_: int, max_rounds: int = 5, boost: float = 2.0, decay: float = 0.5) -> DataFrame:
    """Weights after so many rounds of boost and decay, with sum 1; before the first, as they are. Rounds end before max_rounds.

    As every round only scales, r rounds are one power of the label's factor.
    """
    r = min(round_, max(max_rounds - 1, 0))
    if r < 1:
        return weights.select(id_col, label, "weight")
    factor = F.when(F.col(label) == "proponent", boost**r).when(F.col(label) == "opponent", decay**r).otherwise(1.0)
    rows = weights.select(id_col, label, (F.col("weight") * factor).alias("w"))
    return beside(rows, rows.agg(F.sum("w").alias("total"))).select(id_col, label, (F.col("w") / F.col("total")).alias("weight"))


def rounds(weights: DataFrame, id_col: str, label: str, last: int, boost: float = 2.0, decay: float = 0.5) -> DataFrame:
    """id, round and weight for the rounds 0 to last, as reweighted() has them, in one pass."""
    factor = F.when(F.col(label) == "proponent", F.lit(boost)).when(F.col(label) == "opponent", F.lit(decay)).otherwise(1.0)
    each = weights.select(id_col, "weight", factor.alias("__f"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("round"))
    each = each.withColumn("__w", F.col("weight") * F.pow("__f", "round"))
    totals = each.groupBy("round").agg(F.sum("__w").alias("__total"))  # a row for each round
    scaled = F.when(F.col("round") == 0, F.col("weight")).otherwise(F.col("__w") / F.col("__total"))
    return each.join(F.broadcast(totals), "round").select(id_col, "round", scaled.alias("weight"))


def report(weights: DataFrame, label: str = "label") -> DataFrame:
    """How many of each label, and the ends and mean of the weights."""
    return weights.agg(
        *[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in ("proponent", "opponent", "neutral")],
        F.count(F.lit(1)).alias("n"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"),
    )


def nearest_of_cluster(rows: DataFrame, cluster: str, distance: str, id_col: str) -> DataFrame:
    """The row of each cluster with the least distance; ties by id."""
    w = Window.partitionBy(cluster).orderBy(distance, id_col)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
