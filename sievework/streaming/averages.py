"""Online state of the sampler: the moving average of each key's values over a stream of steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sampling
from ..operators.scalars import beside
from ..sources.tables import exists, written

OUT = "key string, ema double, steps long, use_uniform boolean"


def moving_averages(stream: DataFrame, key: str, at: str, value: str, order: str, alpha: float = 0.95, threshold: float = 0.05, late: str = "1 hour") -> DataFrame:
    """key, ema, steps and use_uniform of the keys that a micro-batch has rows for. A key's state goes when the watermark
    is a day past its last row. Rows of one batch are taken in the order of time and ``order``; they meet in one task, so a stream's micro-batches should be bounded where a key is hot."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ema, steps = state.get if state.exists else (None, 0)
        rows = pd.concat([b[["at", "ord", "x"]] for b in batches]).sort_values(["at", "ord"])
        for x in rows["x"].dropna().to_numpy():
            ema = x if ema is None else alpha * ema + (1 - alpha) * x
            steps += 1
        if ema is None:
            return
        state.update((float(ema), int(steps)))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + 24 * 3600 * 1000)
        yield pd.DataFrame({"key": [name[0]], "ema": [ema], "steps": [steps], "use_uniform": [bool(ema < threshold)]})

    rows = stream.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("x"), F.col(order).alias("ord"))
    return rows.groupBy("key").applyInPandasWithState(step, OUT, "ema double, steps long", "update", GroupStateTimeout.EventTimeTimeout)


STATE = "key string, ema double, steps long, last timestamp"


def fold_averages(
    stream: DataFrame, key: str, at: str, value: str, order: str, path: str, checkpoint: str, alpha: float = 0.95, forget: str = "1 day", rows: int | None = None
) -> None:
    """Moving averages whose keys may be hot: each micro-batch is summed in blocks of key and time, as in sampling.ema(), and a key's few blocks go on from
    its average before. path/epoch=N has the averages after micro-batch N: OUT, and the time of the last row.

    A key without rows for so long (by the rows' own times) is forgotten. A micro-batch that is run again reads those of the one before it. Null values
    do not count.
    """
    spark = stream.sparkSession

    def fold(df: DataFrame, epoch: int) -> None:
        df = written(df.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.struct(F.col(at).alias("at"), F.col(order).alias("order")).alias("place"), F.col(value).cast("double").alias("x")), "arrived")
        found = spark.read.schema(f"{STATE}, epoch long").parquet(path).where(F.col("epoch") == epoch - 1).drop("epoch") if exists(spark, path) else spark.createDataFrame([], STATE)
        _, blocks = sampling.in_blocks(df, "key", "place", "x", alpha)
        lasts = df.where("x is not null").groupBy("key").agg(F.max("at").alias("now"))
        both = found.join(blocks.join(lasts, "key"), "key", "full_outer")
        start = F.coalesce("ema", F.get("blocks", F.lit(0))["first"])
        ema = F.aggregate("blocks", start, lambda s, b: F.pow(F.lit(alpha), b["n"]) * s + b["added"])
        steps = F.aggregate("blocks", F.coalesce("steps", F.lit(0)).cast("long"), lambda s, b: s + b["n"])
        rows = both.select("key", F.coalesce(ema, "ema").alias("ema"), F.coalesce(steps, "steps").alias("steps"), F.greatest("last", "now").alias("last"))
        newest = rows.agg(F.max("last").alias("newest"))
        kept = beside(rows, newest).where(F.col("last") >= F.col("newest") - F.expr(f"INTERVAL {forget}")).drop("newest")
        kept.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start()
    query.awaitTermination()
    read = sum(x.numInputRows for x in query.recentProgress)
    if rows is not None and read != rows:
        raise ValueError(f"the stream has read {read} rows of {rows}")


def averages(spark: SparkSession, path: str, threshold: float = 0.05) -> DataFrame:
    """OUT after the last micro-batch of fold_averages()."""
    if not exists(spark, path):  # a stream without rows has no micro-batch
        return spark.createDataFrame([], OUT)
    found = spark.read.schema(f"{STATE}, epoch long").parquet(path)
    last = found.agg(F.max("epoch")).first()[0]
    return found.where(F.col("epoch") == last).select("key", "ema", "steps", (F.col("ema") < threshold).alias("use_uniform"))


def windowed(stream: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, mean and sample variance of each key in windows of time: in append mode once the watermark has passed them, in update mode whenever they change."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
        .select(F.col("w.start").alias("start"), "key", "n", "mean", "var")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", rows: int | None = None, hooks: Sequence[tuple[int, Callable[[int], None]]] = ()) -> None:
    """Runs over all that is there now; each micro-batch overwrites its own folder, so that a repeated one counts once.

    With rows, it is an error if the stream has read more or fewer. Each hook (n, f) is called with the number of every n-th micro-batch, once it is
    written: to save a checkpoint, or to score anew.
    """

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for every, hook in hooks:
            if epoch > 0 and epoch % every == 0:
                hook(epoch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    read = sum(x.numInputRows for x in query.recentProgress)
    if rows is not None and read != rows:
        raise ValueError(f"the stream has read {read} rows of {rows}")


def last_states(spark: SparkSession, path: str, kind: str, keys: list[str]) -> DataFrame:
    """Of the micro-batches in update mode that run_to_table wrote, the last row of each key. kind: the columns of a row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):  # a stream without rows has no micro-batch
        return spark.createDataFrame([], kind)
    found = spark.read.schema(f"{kind}, epoch long").parquet(path)
    rest = [c for c in found.columns if c not in (*keys, "epoch")]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("s"))
    return last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
