"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger neighbours (large), or itself and its smaller ones (small), get an edge to the smallest of all."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself. Stars keep what is connected, so these then are the components."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up * down > 0").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of each node of edges u, v; nodes without edges are not there.

    Each round is a table in the shared folder, and the one before it goes. Every component becomes a star in about log(n)**2 rounds,
    which ends this. For more edges to components that are known, give their stars with the edges.
    """
    with shared.Workspace(edges.sparkSession, "components") as work:
        now = work.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        while not _is_forest_of_stars(now):
            now = work.rewritten(_star(_star(now, True), False).distinct(), "edges")
        return shared.written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct()), "roots")
