"""Aggregates beside each row: the one row of an aggregate without keys, and the row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row, such as an aggregate without keys."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one").drop("__one")


#: Rows up to which figures by key are sent to all executors.
MOST_SENT = 200_000


def beside_key(df: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """df with the columns of a frame of one row for each key. A small one goes to all executors, so that no task gets all rows of a key; a
    larger one meets df by a shuffle."""
    small = by_key.limit(MOST_SENT + 1).count() <= MOST_SENT
    return df.join(F.broadcast(by_key) if small else by_key, key)
