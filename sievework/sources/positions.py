"""Rows by their position in a table of many files.

A file's rows are numbered where they are read; the files, in the order of their names, have their first row's number from counts alone, one for each file. So
a position is the file's first number plus the row's place in it, without a sort or a task that sees all rows. Positions hold for files as they are:
a table that is written anew has others, as its rows may lie elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scalars import beside_key

FILE, ROW = "__file", "__row"


def numbered(rows: DataFrame, position: str = "position") -> DataFrame:
    """The rows of a table as spark.read.parquet() gives it, with their position, from 0. Files without rows have none."""
    placed = rows.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    counts = placed.groupBy(FILE).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each file
    before = F.coalesce(F.sum("__n").over(Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(FILE, before.alias("__start"))
    return beside_key(placed, starts, FILE).withColumn(position, F.col("__start") + F.col(ROW)).drop(FILE, ROW, "__start")


def read_numbered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    return numbered(spark.read.parquet(path), position)


def rows_between(rows: DataFrame, start: int, stop: int, position: str = "position") -> DataFrame:
    """The rows from one position on and before another."""
    return rows.where((F.col(position) >= start) & (F.col(position) < stop))


def gathered(rows: DataFrame, wanted: DataFrame, place: str = "place", position: str = "position") -> DataFrame:
    """The row of each position that is wanted (place, position), in the order of places: partitions are ranges of places, and sorted. A position may be wanted
    often; one that no row has is an error, negative ones count from the end."""
    n = rows.count()
    index = F.when(F.col(position) < 0, F.col(position) + n).otherwise(F.col(position))
    bad = wanted.where((index < 0) | (index >= n) | F.col(position).isNull()).limit(1).collect()
    if bad:
        raise IndexError(f"there is no row at {bad[0][position]} of {n}")
    asked = wanted.select(F.col(place), index.alias(position))
    return beside_key(asked, rows, position).repartitionByRange(place).sortWithinPartitions(place)


def joined_by_position(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Each left row with the right one of the same position; it is an error if they are not equally many."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"there are {a} rows on the left and {b} on the right")
    return left.join(right, position)


def with_column_by_position(rows: DataFrame, values: DataFrame, name: str, position: str = "position") -> DataFrame:
    """rows with the only other column of values (position, value), under a name that they must not have yet."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name!r}")
    value = next(c for c in values.columns if c != position)
    return joined_by_position(rows, values.select(position, F.col(value).alias(name)), position)
