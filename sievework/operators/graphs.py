"""Connected parts of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Workspace


def connected(edges: DataFrame, work: Workspace) -> DataFrame:
    """c and part, the smallest node that it is connected with, of all nodes of edges (a, b).

    Stars by turns: each node's larger neighbours go to its smallest one, then its smaller ones do, until nothing moves. What a node has
    is the least of its neighbours, an aggregate, so a node of many is no group of many.
    """
    now = work.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = work.written(small, "small")
        if not small.exceptAll(now).limit(1).count() and not now.exceptAll(small).limit(1).count():
            return now.select(F.col("u").alias("c"), F.col("v").alias("part")).unionByName(now.select(F.col("v").alias("c"), F.col("v").alias("part"))).distinct()
        now = small
