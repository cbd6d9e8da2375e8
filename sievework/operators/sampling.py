"""Seeded sampling that does not hang on partitions, temperature schedules, and importance batches.

The order of a seeded shuffle is that of md5(seed:id). A uniform number comes from its first 13 hexadecimal digits.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .scalars import beside, beside_key


def shuffle_key(seed: int | str, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def uniform(seed: int | str, *ids: str) -> Column:
    """A number between 0 and 1, both excluded."""
    return (F.conv(F.substring(shuffle_key(seed, *ids), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


#: Rows among which the k-th key is found by sorting; before, keys between two of a sample of so many are left.
FEW, SAMPLE = 50_000, 1000


def first_rows(df: DataFrame, k: int, *keys: Column | str, descending: bool = False) -> DataFrame:
    """The first k rows (all, if fewer) in the order of keys that are the same each time they are worked out.

    The k-th key is found among the keys alone, and the rows are filtered by it where they are: no task holds all k.
    """
    if k <= 0:
        return df.limit(0)
    key = F.struct(*[(F.col(x) if isinstance(x, str) else x).alias(f"k{i}") for i, x in enumerate(keys)])
    alone = df.select(key.alias("__key"))
    cut = kth_key(alone, k, descending)
    if cut is None:
        return df
    before, same = F.col("__key") > F.col("__cut") if descending else F.col("__key") < F.col("__cut"), F.col("__key") == F.col("__cut")
    n, equal = beside(alone, cut).agg(F.count_if(before), F.count_if(same)).first()
    keyed = beside(df.withColumn("__key", key), cut)
    if n + equal == k:
        return keyed.where(before | same).drop("__key", "__cut")
    # rows of the same key as the k-th are repeated ones
    return keyed.where(before).unionByName(keyed.where(same).limit(k - n)).drop("__key", "__cut")


def kth_key(alone: DataFrame, k: int, descending: bool = False) -> DataFrame | None:
    """The k-th value of the only column, __key, as one row of __cut; None if there are fewer.

    The k-th lies between two of a random sample's keys, which counts of all rows tell; this goes on between the two until few rows are left. The
    sample decides only how soon that is.
    """
    spark, left, n = alone.sparkSession, alone, alone.count()
    if k > n:
        return None
    order = F.desc("__key") if descending else F.asc("__key")
    one = lambda row: spark.createDataFrame([row], alone.schema)
    for turn in itertools.count():
        if n <= FEW:
            return one(left.orderBy(order).limit(k).orderBy(F.asc("__key") if descending else F.desc("__key")).first()).withColumnRenamed("__key", "__cut")
        some = left.orderBy(F.rand(turn)).limit(SAMPLE).orderBy(order).collect()
        at = k * len(some) // n
        ends = [some[max(0, at - SAMPLE // 25)], some[min(len(some) - 1, at + SAMPLE // 25)]]
        both = beside(beside(left, one(ends[0]).withColumnRenamed("__key", "__a")), one(ends[1]).withColumnRenamed("__key", "__b"))
        less = (lambda x, y: x > y) if descending else (lambda x, y: x < y)
        x, a, b = F.col("__key"), F.col("__a"), F.col("__b")
        before_a, with_a, before_b, with_b = both.agg(F.count_if(less(x, a)), F.count_if(~less(a, x)), F.count_if(less(x, b)), F.count_if(~less(b, x))).first()
        if before_a < k <= with_a or before_b < k <= with_b:
            return one(ends[0] if before_a < k <= with_a else ends[1]).withColumnRenamed("__key", "__cut")
        inside, skipped, n = (less(x, a), 0, before_a) if k <= before_a else (less(b, x), with_b, n - with_b) if k > with_b else (less(a, x) & less(x, b), with_a, before_b - with_a)
        left, k = both.where(inside).drop("__a", "__b"), k - skipped


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer) without replacement."""
    return first_rows(df, n, shuffle_key(seed, id_col), id_col)


def share(n: int, fraction: float) -> int:
    return max(1, int(n * fraction))


def split_holdout(df: DataFrame, id_col: str, fraction: float = 0.05, least: int = 10, seed: int = 42) -> DataFrame:
    """The rows with holdout: true for the first max(least, n * fraction) in shuffled order."""
    n = df.count()
    first = hash_sample(df.select(id_col), id_col, max(least, int(n * fraction)), seed).withColumn("holdout", F.lit(True))
    return df.join(first, id_col, "left").withColumn("holdout", F.coalesce("holdout", F.lit(False)))


def candidates(df: DataFrame, id_col: str, batch: int, multiplier: int = 4, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """batch * multiplier rows at most, none of those to exclude."""
    pool = df if exclude is None else df.join(exclude.select(id_col), id_col, "left_anti")
    return hash_sample(pool, id_col, batch * multiplier, seed)


def weighted_sample(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, one after the other with chances in proportion to their weights: exponential keys. Weights of 0 or less are never drawn."""
    return first_rows(df.where(F.col(weight) > 0), n, -F.ln(uniform(seed, id_col)) / F.col(weight), id_col)


def round_seed(seed: int, round_: int) -> int:
    """The seed of a round: the pool is shuffled anew for each."""
    return seed + round_


def rows_of(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose ids a table has."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def resample(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 42, least_buckets: int = 64, per_bucket: int = 10_000, draws_at_once: int = 1_000_000) -> DataFrame:
    """n draws with replacement, in proportion to the weights: draw and id.

    Rows lie on a line, each as long as its weight, in order of a bucket and the id. A draw is a point; a binary search among the buckets'
    ends (a number for each ``per_bucket`` rows) finds its bucket, and another one in the bucket its row. A bucket that gets more draws than
    ``draws_at_once`` is there several times.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("__id"), F.col(weight).cast("double").alias("__w")).where("__w > 0")
    buckets = max(least_buckets, math.ceil(rows.count() / per_bucket))
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring(shuffle_key("bucket", "__id"), 1, 7), 16, 10).cast("long"), F.lit(buckets)))
    sums = rows.groupBy("bucket").agg(F.sum("__w").alias("w")).orderBy("bucket").toPandas()
    number, stop = sums["bucket"].to_numpy(np.int64), np.cumsum(sums["w"].to_numpy(float))
    start, total = stop - sums["w"].to_numpy(float), float(stop[-1]) if len(stop) else 0.0
    times = np.maximum(1, np.ceil(n * (stop - start) / max(total, 1e-300) / draws_at_once)).astype(np.int64)

    def deal(batches):
        for x in batches:
            at = x.column(1).to_numpy() * total
            i = np.minimum(np.searchsorted(stop, at, "right"), len(stop) - 1)
            copy = x.column(0).to_numpy() % times[i]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(number[i]), pa.array(copy), pa.array(at - start[i])], ["draw", "bucket", "copy", "at"])

    def search(rows: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__id", kind="stable")
        i = np.searchsorted(np.cumsum(rows["__w"].to_numpy()), draws["at"].to_numpy(), "right")
        return pd.DataFrame({"draw": draws["draw"].to_numpy(), id_col: rows["__id"].to_numpy()[np.minimum(i, len(rows) - 1)]})

    points = spark.range(n if len(stop) else 0).withColumnRenamed("id", "draw")
    dealt = points.select("draw", uniform(seed, "draw").alias("u")).mapInArrow(deal, "draw long, bucket long, copy long, at double")
    several = spark.createDataFrame([(int(b), int(t)) for b, t in zip(number, times, strict=True) if t > 1], "bucket long, times long")
    copies = rows.join(F.broadcast(several), "bucket", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("times", F.lit(1)) - 1))).drop("times")
    return copies.groupBy("bucket", "copy").cogroup(dealt.groupBy("bucket", "copy")).applyInPandas(lambda a, b: search(a, b), f"draw long, {id_col} {kind}")


STRATEGIES = ("linear", "cosine", "constant")


def temperature(step: Column, strategy: str = "linear", initial: float = 1.0, least: float = 0.1, length: int = 5000) -> Column:
    """The temperature at a step; from ``length`` on the least, but for the constant one."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if strategy == "constant":
        return F.lit(float(initial)) + step * 0.0
    done = step / F.lit(float(length))
    if strategy == "linear":
        now = F.lit(initial) + (least - initial) * done
    else:
        now = F.lit(least) + 0.5 * (initial - least) * (1 + F.cos(F.lit(3.141592653589793) * done))
    return F.when(step >= length, F.lit(float(least))).otherwise(now)


def softmax(df: DataFrame, score: str, tau: str, by: str) -> DataFrame:
    """p, the softmax of score / tau over the rows of a key, and n, how many these are.

    The greatest score and the sum of a key are aggregated before they meet the rows, so a key's rows need not be in one task. Null keys are left out.
    """
    up = df.withColumn("__z", F.col(score) / F.col(tau))
    up = beside_key(up, up.groupBy(by).agg(F.max("__z").alias("__most")), by).withColumn("__e", F.exp(F.col("__z") - F.col("__most")))
    sums = up.groupBy(by).agg(F.sum("__e").alias("__sum"), F.count(F.lit(1)).alias("n"))
    return beside_key(up.drop("n"), sums, by).withColumn("p", F.col("__e") / F.col("__sum")).drop("__z", "__most", "__e", "__sum")


def softmax_of_few(df: DataFrame, score: str, tau: str, by: str) -> DataFrame:
    """softmax() where a key has few rows."""
    group = Window.partitionBy(by)
    z = F.col(score) / F.col(tau)
    up = df.withColumn("__e", F.exp(z - F.max(z).over(group)))
    return up.withColumns({"p": F.col("__e") / F.sum("__e").over(group), "n": F.count(F.lit(1)).over(group)}).drop("__e")


def importance_weight(p: Column, n: Column, clip: float | None = 10.0) -> Column:
    """1 / (p n), at most clip."""
    w = 1 / (p * n)
    return w if clip is None else F.least(w, F.lit(float(clip)))


def importance_batches(
    losses: DataFrame, id_col: str, step: str, loss: str, batch: int = 4, multiplier: int = 4, strategy: str = "linear", length: int = 5000, clip: float = 10.0, seed: int = 42, fallback: DataFrame | None = None
) -> DataFrame:
    """A batch for each step of a table of losses (id, step, loss): id, step, p, n and weight.

    Each step takes batch * multiplier candidates, and draws the batch from them without replacement with chances
    softmax(loss / temperature). Steps that fallback (a table of steps) has take a uniform batch with weights 1.
    """
    order = Window.partitionBy(step).orderBy(shuffle_key(seed, id_col, step), id_col)
    few = losses.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= batch * multiplier)
    few = few.withColumn("tau", temperature(F.col(step), strategy, length=length))
    scored = softmax_of_few(few, loss, "tau", step)
    if fallback is not None:
        scored = scored.join(fallback.select(step).distinct().withColumn("__uniform", F.lit(True)), step, "left")
        flat = F.coalesce("__uniform", F.lit(False))
        scored = scored.withColumn("__flat", flat).withColumn("p", F.when(flat, 1 / F.col("n")).otherwise(F.col("p")))
    draw = Window.partitionBy(step).orderBy(-F.ln(uniform(f"draw{seed}", id_col, step)) / F.greatest("p", F.lit(1e-300)), id_col)
    drawn = scored.withColumn("__place", F.row_number().over(draw)).where(F.col("__place") <= batch)
    weight = importance_weight(F.col("p"), F.col("n"), clip)
    weight = weight if fallback is None else F.when(F.col("__flat"), 1.0).otherwise(weight)
    return drawn.select(id_col, step, loss, "tau", "p", "n", weight.alias("weight"))


def uniform_batches(losses: DataFrame, id_col: str, step: str, batch: int = 4, seed: int = 42) -> DataFrame:
    """Per step, batch rows (fewer, if there are fewer) with weight 1."""
    order = Window.partitionBy(step).orderBy(shuffle_key(seed, id_col, step), id_col)
    return losses.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= batch).select(id_col, step, F.lit(1.0).alias("weight"))


def variance_reduction(batches: DataFrame, step: str, loss: str, p: str, n: str | None = None) -> DataFrame:
    """eta = 1 - var(loss / p) / var(loss) of each step, by sample variances; steps of one row or without variance are left out.

    With n, the losses are divided by p n, so that a uniform batch has eta 0.
    """
    scale = F.col(p) + 1e-8 if n is None else (F.col(p) + 1e-8) * F.col(n)
    both = batches.groupBy(step).agg(F.var_samp(F.col(loss) / scale).alias("imp"), F.var_samp(loss).alias("uni"))
    return both.where("uni > 0 and imp is not null").select(step, (1 - F.col("imp") / F.col("uni")).alias("eta"))


def step_stats(drawn: DataFrame, step: str = "step", loss: str = "loss") -> DataFrame:
    """Of each step's batch: temperature, candidates, rows, mean loss and weight, and the variance saved (eta; null of one row)."""
    saved = variance_reduction(drawn, step, loss, "p")
    each = drawn.groupBy(step).agg(F.max("tau").alias("tau"), F.max("n").alias("candidates"), F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("mean_loss"), F.avg("weight").alias("mean_weight"))
    return each.join(saved, step, "left")


def in_blocks(etas: DataFrame, key: str, step: str, value: str, alpha: float, twice: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows (key, step, value) that have a value, with the block that they are in; and for each key its blocks in order: n rows, the sum that they
    add to the average, and the first value. Blocks are ranges of key and step, so a key of many rows has many. If the rows are read
    twice, they are a table, so that blocks are the same each time."""
    rows = etas.select(key, step, F.col(value).cast("double").alias("__x")).where("__x is not null")
    rows = rows.repartitionByRange(F.col(key), F.col(step)).withColumn("__block", F.spark_partition_id())
    rows = written(rows, "blocks") if twice else rows
    here = Window.partitionBy(key, "__block")
    after = F.count(F.lit(1)).over(here) - F.row_number().over(here.orderBy(step))
    placed = rows.withColumn("__after", after)
    sums = placed.groupBy(key, "__block").agg(
        F.count(F.lit(1)).alias("n"), F.sum((1 - alpha) * F.pow(F.lit(alpha), "__after") * F.col("__x")).alias("added"), F.max_by("__x", "__after").alias("first")
    )
    blocks = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__block", "n", "added", "first"))).alias("blocks"))
    return rows, blocks


def ema(etas: DataFrame, key: str, step: str, value: str = "eta", alpha: float = 0.95, threshold: float = 0.05) -> DataFrame:
    """The moving average of each key's values in the order of steps, the first as it is; and whether it is below the threshold.

    n rows take an average s to alpha**n s + what they add, so each block of rows is summed by itself, and a key's few blocks follow one another.
    """
    _, blocks = in_blocks(etas, key, step, value, alpha)
    last = F.aggregate("blocks", F.get("blocks", F.lit(0))["first"], lambda s, b: F.pow(F.lit(alpha), b["n"]) * s + b["added"])
    steps = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b["n"])
    return blocks.select(key, last.alias("ema"), steps.alias("steps")).withColumn("use_uniform", F.coalesce(F.col("ema") < threshold, F.lit(False)))


def running_ema(etas: DataFrame, key: str, step: str, value: str = "eta", alpha: float = 0.95, start: float | None = None) -> DataFrame:
    """key, step and ema, the moving average of ema() after each step; with start, that of values before these."""
    rows, blocks = in_blocks(etas, key, step, value, alpha, twice=True)
    earlier = lambda b: F.slice("blocks", F.lit(1), b)
    begin = F.get("blocks", F.lit(0))["first"] if start is None else F.lit(float(start))
    before = lambda b: F.aggregate(earlier(b), begin, lambda s, x: F.pow(F.lit(alpha), x["n"]) * s + x["added"])
    starts = blocks.select(key, F.posexplode("blocks").alias("at", "b"), "blocks").select(key, F.col("b.__block").alias("__block"), before(F.col("at")).alias("__start"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(step, kind="stable")
        values = itertools.accumulate(x["__x"], lambda s, v: alpha * s + (1 - alpha) * v, initial=x["__start"].iloc[0])
        return x[[key, step]].assign(ema=list(values)[1:])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(starts, [key, "__block"]).groupBy(key, "__block").applyInPandas(run, f"{key} {kind[key]}, {step} {kind[step]}, ema double")


def guarded_batches(losses: DataFrame, id_col: str, step: str, loss: str, alpha: float = 0.95, threshold: float = 0.05, **how) -> DataFrame:
    """importance_batches() with the tracker closed around them: from the step after that at which the moving average of the variance that
    they save falls below the threshold, batches are uniform. As a uniform batch tells nothing of that variance, this lasts."""
    return guarded_from(losses, id_col, step, loss, alpha, threshold, **how)[0]


def guarded_from(
    losses: DataFrame, id_col: str, step: str, loss: str, alpha: float = 0.95, threshold: float = 0.05, start: float | None = None, first: int | None = None, **how
) -> tuple[DataFrame, float | None, int | None]:
    """guarded_batches() of further steps, the moving average after them, and the step at which it fell below the threshold. start and first: these two as
    the steps before left them, None of none."""
    if first is None:
        etas = variance_reduction(importance_batches(losses, id_col, step, loss, **how), step, loss, "p").withColumn("__all", F.lit(0))
        path = running_ema(etas, "__all", step, "eta", alpha, start)
        end = path.agg(F.min(F.when(F.col("ema") < threshold, F.col(step))).alias("first"), F.max_by("ema", step).alias("all"), F.count(F.lit(1)).alias("n")).first()
        first, start = end["first"], start if not end["n"] else end["all"]
        if first is not None:  # steps after the first one below tell nothing
            start = path.where(F.col(step) == first).first()["ema"]
    fallback = losses.select(step).distinct().where(F.lit(first is not None) & (F.col(step) > F.lit(-1 if first is None else first)))
    return importance_batches(losses, id_col, step, loss, fallback=fallback, **how), start, first


def weighted_loss(batches: DataFrame, step: str, loss: str, weight: str) -> DataFrame:
    """A step's mean loss times its mean weight, as a trainer that weighs a batch's loss has it; and the mean of weighted losses."""
    return batches.groupBy(step).agg(
        (F.avg(loss) * F.avg(weight)).alias("batch_weighted"), F.avg(F.col(loss) * F.col(weight)).alias("sample_weighted")
    )


def with_weights(df: DataFrame, weights: DataFrame, id_col: str, weight: str = "weight") -> DataFrame:
    """Each row's weight, 1 where the table has none."""
    return df.join(weights.select(id_col, weight), id_col, "left").withColumn(weight, F.coalesce(weight, F.lit(1.0)))
