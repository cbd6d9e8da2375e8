"""Tables and small files in the folder that driver and executors share, and what the operators have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids and numbers goes to every executor; longer ones are joined by a shuffle.
MOST_SENT = 200_000
#: Bytes of an Arrow batch: whole texts are large, and a batch is held several times over.
BATCH_BYTES = "1m"


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of this machine, for a session without executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/sievework"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables of one run of an operator, all in one folder, which goes when the run ends. What the run returns is written elsewhere."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n, self.paths = spark, scratch(spark, name), 0, {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        drop(self.spark, self.path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        self.paths[name] = path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def rewritten(self, df: DataFrame, name: str) -> DataFrame:
        """written(), after which the table that had the name before is deleted: df may read that one, but nothing else may any more."""
        before = self.paths.get(name)
        found = self.written(df, name)
        if before:
            drop(self.spark, before)
        return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df by their names, dots and spaces included."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in df.columns]


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The names wanted, each longer by as many underscores as make it one that is not taken; case does not count."""
    taken = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def is_small(df: DataFrame, most: int = MOST_SENT) -> bool:
    return df.limit(most + 1).count() <= most


def sent_if_small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, to be sent to every executor if it has ``most`` rows or fewer."""
    return F.broadcast(df) if is_small(df, most) else df


def looked_up(rows: DataFrame, values: DataFrame, key: str, most: int = 10_000, least: int = 1000) -> DataFrame:
    """rows with the columns of values (one row for each key), null where it has none.

    Keys that make up more than one ``most``-th of the rows, and more than ``least`` of them, are at most ``most`` in number: their
    values go to every executor, so that no task gets all rows of such a key. All others meet by a shuffle. Both are read more than once.
    """
    often = F.col("count") > max(least, rows.count() // most)
    hot = F.broadcast(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(often).select(key).join(values, key))
    rest = rows.join(hot.select(key), key, "left_anti").join(values, key, "left")
    return rows.join(hot, key).unionByName(rest)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch() gave."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most so many bytes, but for a row that is longer."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of another and bounded batches, so that those of the other stay as they are."""
    own = spark.newSession()
    for x in spark.sql("SET").collect():
        if x["key"].startswith("spark.sql.") and spark.conf.isModifiable(x["key"]):
            own.conf.set(x["key"], x["value"])
    bound_batches(own)
    return own
