"""Scans and sinks: pools, score tables, checkpoints and catalogs as Parquet in folders that all executors reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, in a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/sievework"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables of one run, all in one folder, which is deleted when the run ends. What the run returns is written elsewhere."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, scratch(spark, name), 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}-{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}-{name}")


def read_pool(spark: SparkSession, path: str, split: str | None = None, num_samples: int | None = None, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """A pool of samples; split is a partition folder. A split that is not there is an error, never another split."""
    from ..operators.sampling import hash_sample

    pool = spark.read.parquet(path if split is None else f"{path}/split={split}")
    return pool if num_samples is None else hash_sample(pool, id_col, num_samples, seed)


def write_scores(scores: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """A score table; with keys (dim, round, step) a write replaces the partitions that it has rows for, so it can be repeated."""
    writer = scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_checkpoint(params: DataFrame, path: str, step: int) -> None:
    """One checkpoint's parameters (name, values, lr) under step=N."""
    params.withColumn("step", F.lit(step).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def checkpoint_steps(checkpoints: DataFrame) -> DataFrame:
    """The steps there are, as numbers: 50 comes before 100."""
    return checkpoints.select(F.col("step").cast("long").alias("step")).distinct()


def retained(steps: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` of the steps; the others are to be deleted."""
    return steps.orderBy(F.desc("step")).limit(most)


def folders(spark: SparkSession, path: str, key: str) -> dict[int, object]:
    """The partition folders key=NUMBER of a table by their number; others are passed over, and a table that is not there has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(at) if x.isDirectory()] if files.exists(at) else []
    return {int(m[1]): x for x in found if (m := re.fullmatch(rf"{key}=(\d+)", x.getName()))}


def prune_checkpoints(spark: SparkSession, path: str, most: int) -> list[int]:
    """Deletes all but the newest ``most`` checkpoints of a folder; the steps that stay."""
    found = folders(spark, path, "step")
    kept = sorted(found)[-most:] if most > 0 else []
    for step, x in found.items():
        if step not in kept:
            x.getFileSystem(spark._jsc.hadoopConfiguration()).delete(x, True)
    return kept


def resumed(spark: SparkSession, path: str, steps: Sequence[int], score: Callable[[int], DataFrame]) -> DataFrame:
    """The scores of all steps, with the column step: those that ``path`` has from a run before are read, the others made and written, one
    step at a time. A step that was broken off left no _SUCCESS, and is made again."""
    for step in steps:
        at = f"{path}/step={step}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            score(step).write.mode("overwrite").parquet(at)
    found = spark.read.option("basePath", path).parquet(*[f"{path}/step={step}" for step in steps])
    return found.withColumn("step", F.col("step").cast("long"))


def load_checkpoint(checkpoints: DataFrame, names: DataFrame, step: int) -> DataFrame:
    """name and values for each name that the model asks for: matched by its normalised form, else as it is, else by its end.

    Normalised names lack the wrapper prefix ``base_model.model.`` and the adapter suffix ``.default``.
    """
    normal = lambda c: F.regexp_replace(F.regexp_replace(c, r"^base_model\.model\.", ""), r"\.default(?=\.|$)", "")
    have = checkpoints.where(F.col("step") == step).select(F.col("name").alias("saved"), "values")
    want = names.select("name")
    tail = lambda c: F.substring_index(c, ".", -3)
    tiers = [
        want.join(have, normal(F.col("name")) == normal(F.col("saved"))).withColumn("tier", F.lit(1)),
        want.join(have, F.col("name") == F.col("saved")).withColumn("tier", F.lit(2)),
        want.join(have, tail(F.col("name")) == tail(F.col("saved"))).withColumn("tier", F.lit(3)),
    ]
    found = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    return found.groupBy("name").agg(F.min(F.struct("tier", "saved", "values")).alias("m")).select("name", "m.saved", "m.values")


def spread(steps: Sequence[int], most: int = 6) -> list[int]:
    """At most ``most`` of the steps in order, evenly apart, first and last included."""
    steps = sorted(steps)
    if len(steps) <= most:
        return steps
    return [steps[0], *(steps[int(k * (len(steps) - 1) / (most - 1))] for k in range(1, most))] if most > 1 else steps[:1]


def validation_catalog(sources: Mapping[str, DataFrame], most: int = 500, seed: int = 42) -> DataFrame:
    """dim, sample_id and text of each validation set, at most ``most`` rows of each by hash order; a set without rows has none."""
    from ..operators.sampling import hash_sample

    parts = [hash_sample(df.select("sample_id", "text"), "sample_id", most, seed).withColumn("dim", F.lit(dim)) for dim, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ASKED = ("Tell me about {topic}.", "Why does {topic} matter?", "Give a short example of {topic}.")
TOLD = ("{topic} comes up wherever data are large.", "Without {topic} results cannot be trusted.", "A simple case of {topic} has two parts.")
TOPICS = ("sorting", "hashing", "sampling", "joins", "sketches", "windows", "shuffles")
REFUSAL = "I cannot help with that."


def toy_pool(spark: SparkSession, n: int = 100) -> DataFrame:
    """Instruction records by a hash of their number: every 20th has a refusal as its output, every 15th its instruction twice (0 has neither)."""
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("sample_id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    rows = spark.range(n).withColumnRenamed("id", "sample_id").withColumn("topic", pick(TOPICS, "topic"))
    rows = rows.withColumn("t", pick(range(len(ASKED)), "template"))
    fill = lambda texts: F.replace(F.element_at(F.array(*map(F.lit, texts)), F.col("t") + 1), F.lit("{topic}"), F.col("topic"))
    asked, every = fill(ASKED), lambda k: (F.col("sample_id") % k == 0) & (F.col("sample_id") > 0)
    return rows.select(
        "sample_id",
        F.when(every(15), F.concat(asked, F.lit(" "), asked)).otherwise(asked).alias("instruction"),
        F.lit("").alias("input"),
        F.when(every(20), F.lit(REFUSAL)).otherwise(fill(TOLD)).alias("output"),
    )


def ordered_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation: its turns (role, content) in order."""
    one = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("messages")).select(
        key, F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )
