"""Importance batches on a stream: rows arrive with a loss, a step closes when the watermark passes its end, and its batch is drawn.

A step keeps the candidates that the batch form draws from, the first ``batch * multiplier`` of its rows in shuffled order: tasks keep so many
of each step before the shuffle, and the step's state no more, however many rows it has. What steps close in a micro-batch is drawn from
as in sampling.guarded_batches(); the moving average of the variance saved, and the step at which it fell below the threshold, are a table of
one row for each micro-batch, from which the next one goes on. A micro-batch that is run again reads the row of the one before it and
overwrites its own, so each counts once; a stream that is stopped goes on where it was.

Cases: null losses and steps are no candidates; rows of a step that has closed are dropped, as the watermark has it; steps that are open when a run ends
stay in the state, from which open_candidates() reads them, and ``initial`` gives them to a stream that begins anew; repeated rows of an
id are candidates each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sampling
from ..sources.tables import exists, written

#: The state store that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATE = "ema double, first long"


def session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep their state where timers are; the other's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    for name, value in STORE.items():
        own.conf.set(name, value)
    return own


def least(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The first rows of each step in shuffled order."""
    return rows.sort_values(["order", "id"], kind="stable").groupby("step", sort=False).head(most)


class Candidates(StatefulProcessor):
    """A step's candidates, until a timer at its end gives them away."""

    def __init__(self, most: int, kind: str) -> None:
        self.most, self.kind = most, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"ids array<{self.kind}>, orders array<string>, losses array<double>, stop long")

    def _held(self, step: int) -> pd.DataFrame:
        ids, orders, losses, _ = self.kept.get()
        return pd.DataFrame({"step": step, "id": list(ids), "order": list(orders), "loss": list(losses)})

    def _keep(self, step: int, rows: Iterator[pd.DataFrame], stop: int | None = None) -> None:
        known = self.kept.exists()
        held = self._held(step) if known else None
        stop = self.kept.get()[3] if known else stop
        for x in rows:
            stop = int(x["stop"].iloc[0]) if stop is None else stop
            some = x[["step", "id", "order", "loss"]]
            held = least(some if held is None else pd.concat([held, some]), self.most)
        if held is None:
            return
        self.kept.update((held["id"].tolist(), held["order"].tolist(), held["loss"].tolist(), int(stop)))
        if not known:
            self.handle.registerTimer(int(stop))

    def handleInputRows(self, key, rows, timerValues):
        self._keep(key[0], rows)
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(key[0], iter([initialState]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held(key[0]) if self.kept.exists() else None
        self.kept.clear()
        return iter([] if held is None else [held[["step", "id", "loss"]]])

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Steps:
    """What a stream's rows mean: their columns, when a step ends (a timestamp that all rows of a step share), and how batches are drawn."""

    id_col: str
    step: str
    loss: str
    at: str
    stop: Column
    alpha: float = 0.95
    threshold: float = 0.05
    late: str = "0 seconds"
    how: dict = field(default_factory=dict)  # of sampling.importance_batches

    @property
    def most(self) -> int:
        return self.how.get("batch", 4) * self.how.get("multiplier", 4)


def candidates(stream: DataFrame, steps: Steps, initial: DataFrame | None = None) -> DataFrame:
    """step, id and loss of the candidates of each step that closes. initial: what open_candidates() gave."""
    kind, most = stream.schema[steps.id_col].dataType.simpleString(), steps.most
    rows = stream.withWatermark(steps.at, steps.late).select(
        F.col(steps.at).alias("at"), F.col(steps.step).cast("long").alias("step"), F.col(steps.id_col).alias("id"), F.col(steps.loss).cast("double").alias("loss"),
        F.unix_millis(steps.stop.cast("timestamp")).alias("stop"), sampling.shuffle_key(steps.how.get("seed", 42), steps.id_col, steps.step).alias("order"),
    ).where("step is not null and loss is not null")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield least(x, most)

    few = rows.mapInPandas(first, rows.schema)
    out = f"step long, id {kind}, loss double"
    start = None if initial is None else initial.groupBy("step")
    return few.groupBy("step").transformWithStateInPandas(Candidates(most, kind), out, outputMode="Append", timeMode="EventTime", initialState=start)


def open_candidates(spark: SparkSession, checkpoint: str, kind: str = "long") -> DataFrame:
    """step, id, loss, order and stop of the candidates whose steps had not closed when the stream last stopped."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load()
    each = F.arrays_zip(F.col("value.ids").alias("ids"), F.col("value.losses").alias("losses"), F.col("value.orders").alias("orders"))
    rows = state.select(F.col("key.step").alias("step"), F.col("value.stop").alias("stop"), F.explode(each).alias("x"))
    return rows.select("step", F.col("x.ids").cast(kind).alias("id"), F.col("x.losses").alias("loss"), F.col("x.orders").alias("order"), "stop")


def last_state(spark: SparkSession, path: str, before: int | None = None) -> tuple[float | None, int | None]:
    """The moving average and the step from which it was below the threshold, as the last micro-batch (before a given one) left them."""
    if not exists(spark, f"{path}/state"):
        return None, None
    found = spark.read.schema(f"{STATE}, epoch long").parquet(f"{path}/state")
    found = found if before is None else found.where(F.col("epoch") < before)
    row = found.orderBy(F.desc("epoch")).first()  # a row for each micro-batch
    return (None, None) if row is None else (row["ema"], row["first"])


def drawn(rows: DataFrame, steps: Steps, path: str, epoch: int) -> None:
    """The batches, figures and state after the steps of one micro-batch (step, id, loss), as tables below ``path``."""
    spark = rows.sparkSession
    rows = written(rows, "candidates")
    ema, first = last_state(spark, path, epoch)
    found, ema, first = sampling.guarded_from(rows, "id", "step", "loss", steps.alpha, steps.threshold, ema, first, **steps.how)
    found = found.withColumnRenamed("id", steps.id_col)
    found.write.mode("overwrite").parquet(f"{path}/batches/epoch={epoch}")
    spark.createDataFrame([(ema, first)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")


def run(stream: DataFrame, steps: Steps, path: str, checkpoint: str, initial: DataFrame | None = None) -> None:
    """Takes in all that is there now; batches are in path/batches, by micro-batch."""

    def fold(df: DataFrame, epoch: int) -> None:
        drawn(df, steps, path, epoch)

    writer = candidates(stream, steps, initial).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).foreachBatch(fold).start().awaitTermination()


def finish(spark: SparkSession, steps: Steps, path: str, checkpoint: str, kind: str = "long") -> None:
    """Draws the batches of the steps that are open, as no more rows will come."""
    last = spark.read.parquet(f"{path}/state").agg(F.max("epoch")).first()[0]
    drawn(open_candidates(spark, checkpoint, kind).select("step", "id", "loss"), steps, path, int(last) + 1)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches drawn so far: the columns of sampling.importance_batches()."""
    return spark.read.parquet(f"{path}/batches").drop("epoch")
