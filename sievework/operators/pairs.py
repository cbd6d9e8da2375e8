"""Near-duplicate vectors, exact, by a tree of pivots.

Unit vectors of a cosine of t or more lie within sqrt(2 - 2 t) of each other, so their distances to a pivot differ by no more. A cell's rows go to the
nearest of a few pivots among them, which is where they are at home, and as guests to every other one where a row at home may be so near. Cells
of more than LEAF rows are split again, unless that saves too little: where the reach is long or vectors lie equally far from each other, a split
leaves as much to compare. Then cells are handled block against block. A row is sent once for each block of its cell, so the blocks are few: GRID, until
they would be larger than BLOCK rows; a task goes through its two in tiles.

A pair meets where its smaller id is at home, and is made there alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Workspace, written
from .array_sums import matrix
from .influence import in_groups
from .scalars import beside_key

#: Rows of a cell that is not split, pivots of a split, rows that pass by a copy of the pivots, and the share of comparisons that a split must not exceed.
LEAF, PIVOTS, PER_BUCKET, WORTH = 4096, 16, 500_000, 0.7
#: Rows and bytes of a block at most, blocks of a cell as long as that holds, and the sides of a tile.
BLOCK, BLOCK_BYTES, GRID, TILE = 32_768, 1 << 24, 12, (1024, 4096)
CELL = "cell string, home boolean, id long, v array<double>"


def unit_rows(df: DataFrame, id_col: str, vector: str, zeros: bool) -> DataFrame:
    """CELL of all rows in one cell, vectors at length 1; zero vectors, which have no direction, only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(1))
            length = np.linalg.norm(m, axis=1)
            m /= np.maximum(length, 1e-300)[:, None]
            there = np.flatnonzero(length > 0) if not zeros else np.arange(len(m))
            yield rows_of(np.full(len(there), "", object), np.ones(len(there), bool), b.column(0).take(pa.array(there)), m[there])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0").mapInArrow(run, CELL)


def rows_of(cell: np.ndarray, home: np.ndarray, ids: pa.Array, m: np.ndarray) -> pa.RecordBatch:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array(home), ids, lists], ["cell", "home", "id", "v"])


def sizes(rows: DataFrame) -> DataFrame:
    """cell, n, homes and pairs, what is compared in it: each row at home with each row."""
    found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    return found.withColumn("pairs", F.col("homes") * F.col("n"))


def split(rows: DataFrame, counts: DataFrame, reach: float) -> DataFrame:
    """The rows of some cells (of which counts has cell, n and homes) in the cells of their pivots: the first rows at home in hash order."""
    keyed = beside_key(rows, counts.select("cell", "homes", F.ceil(F.col("n") / PER_BUCKET).cast("int").alias("buckets")), "cell")
    # of a large cell few rows are looked at
    order = F.xxhash64("id", F.lit("pivot"))
    few = keyed.where(F.col("home") & (F.pmod(order, F.col("homes")) < 20 * PIVOTS))
    chosen = few.groupBy("cell", "buckets").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("order"), "id", "v"))), 1, PIVOTS).alias("p"))
    parts = keyed.select("cell", F.pmod(F.xxhash64("id"), F.col("buckets")).cast("int").alias("bucket"), F.lit(1).alias("kind"), "home", "id", "v")
    told = chosen.select("cell", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "p").select("cell", "bucket", F.explode("p").alias("p"))
    told = told.select("cell", "bucket", F.lit(0).alias("kind"), F.lit(True).alias("home"), "p.id", "p.v")
    met = told.unionByName(parts).repartition("cell", "bucket").sortWithinPartitions("cell", "bucket", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]):
        where, pivots = None, []
        for b in batches:
            cells = np.array(b.column("cell").to_pylist(), object)
            codes = pa.array(np.unique(cells, return_inverse=True)[1] if len(cells) else np.zeros(0, np.int64))
            coded = pa.RecordBatch.from_arrays([codes, *b.columns[1:]], ["cell", *b.schema.names[1:]])
            done = 0
            for (_, bucket, kind), part in in_groups(coded, "cell", "bucket", "kind"):
                cell = cells[done]
                done += part.num_rows
                m = matrix(part.column("v"))
                if (cell, bucket) != where:
                    where, pivots = (cell, bucket), []
                if not kind:
                    pivots.append(m)
                    continue
                d = np.sqrt(np.maximum(2 - 2 * m @ np.vstack(pivots).T, 0))
                nearest = d.argmin(1)
                # a partner at home with pivot j is within reach, so its distance to j, the least of its own, is within reach of this row's distances
                row, j = np.nonzero(d <= d.min(1, keepdims=True) + 2 * reach + 1e-9)
                home = part.column("home").to_numpy(zero_copy_only=False)[row] & (nearest[row] == j)
                yield rows_of(np.array([f"{cell}.{x}" for x in j], object), home, part.column("id").take(pa.array(row)), m[row])

    return met.mapInArrow(run, CELL)


def cells(df: DataFrame, id_col: str, vector: str, threshold: float, leaf: int = LEAF) -> DataFrame:
    """CELL: the rows of each cell, at home or guests, as a table."""
    reach = math.sqrt(max(0.0, 2 - 2 * max(threshold, -1.0))) + 1e-9
    of = F.regexp_replace("cell", r"\.\d+$", "")
    with Workspace(df.sparkSession, "tree") as work:
        open_, closed = work.written(unit_rows(df, id_col, vector, threshold <= 0), "rows"), []
        while True:
            counts = work.written(sizes(open_), "sizes")
            large = (F.col("n") > leaf) & (F.col("homes") > 1)
            if reach >= 1.9 or not counts.where(large).limit(1).count():
                closed.append(open_)
                break
            found = work.written(split(open_, counts.where(large), reach), "split")
            after = sizes(found).groupBy(of.alias("cell")).agg(F.sum("pairs").alias("after"))
            judged = work.written(counts.join(after, "cell", "left").select("cell", F.coalesce(F.col("after") <= WORTH * F.col("pairs"), F.lit(False)).alias("worth")), "judged")
            closed.append(beside_key(open_, judged, "cell").where("not worth").select(open_.columns))
            if not judged.where("worth").limit(1).count():
                break
            open_ = beside_key(found.withColumn("of", of), judged.withColumnRenamed("cell", "of"), "of").where("worth").select("cell", "home", "id", "v")
        out = closed[0]
        for x in closed[1:]:
            out = out.unionByName(x)
        return written(out, "cells")


def block_rows(dims: int, block: int = BLOCK) -> int:
    """Vectors of a block at most."""
    return max(1, min(block, BLOCK_BYTES // (8 * max(1, dims))))


def grid_parts(n: int, dims: int, block: int = BLOCK) -> int:
    """Blocks of n vectors: GRID at most, of a sixteenth of a block or more, unless they would be larger than a block."""
    rows = block_rows(dims, block)
    return max(1, -(-n // rows), min(GRID, -(-n // max(1, rows // 16))))


def by_id(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of some rows (their last two columns), by id."""
    ids, m = x.column(x.num_columns - 2).to_numpy(), matrix(x.column(x.num_columns - 1).combine_chunks())
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def inner_products(l: np.ndarray, r: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Tile by tile, those of the same rows of l one after the other."""
    for i in range(0, len(l), TILE[0]):
        for j in range(0, len(r), TILE[1]):
            rows, columns = slice(i, i + TILE[0]), slice(j, j + TILE[1])
            yield rows, columns, l[rows] @ r[columns].T


def similar_pairs(df: DataFrame, id_col: str, vector: str, threshold: float, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """i, j of all pairs i < j whose cosine is the threshold or more. Ids are unique; null vectors have no partner, and zero ones a cosine of 0."""
    rows = cells(df, id_col, vector, threshold, leaf)
    size = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"), F.max(F.size("v")).alias("dims")).where("homes > 0")
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dims")))))  # as grid_parts() does
    few = F.least(F.lit(GRID), F.ceil(F.col("n") / F.greatest(F.lit(1), F.floor(most / 16))))
    size = size.select("cell", F.greatest(F.ceil(F.col("n") / most), few).cast("int").alias("parts"), (F.col("homes") == F.col("n")).alias("own"))
    parts = beside_key(rows, size, "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts")).cast("int"))
    # where all are at home, two blocks meet once, and a block meets itself on the left
    last = F.col("parts") - 1
    to = F.sequence(F.when(F.col("own"), F.col("part")).otherwise(0), last)
    of = F.filter(F.sequence(F.lit(0), last), lambda x: ~F.col("own") | (x < F.col("part")))
    left = parts.where("home").select("cell", F.col("part").alias("a"), F.explode(to).alias("b"), "own", F.lit(True).alias("left"), "id", "v")
    right = parts.select("cell", F.explode(of).alias("a"), F.col("part").alias("b"), "own", F.lit(False).alias("left"), "id", "v")

    def meet(x: pa.Table) -> pa.Table:
        own, itself = x.column("own")[0].as_py(), x.column("a")[0].as_py() == x.column("b")[0].as_py()
        ids, m = by_id(x.filter(pc.field("left")))
        others, r = (ids, m) if own and itself else by_id(x.filter(~pc.field("left")))
        found = [np.zeros((2, 0), np.int64)]
        for rows, columns, near in inner_products(m, r):
            a, b = np.nonzero(near >= threshold - 1e-12)
            i, j = ids[rows][a], others[columns][b]
            if own and not itself:
                i, j = np.minimum(i, j), np.maximum(i, j)
            found.append(np.stack([i, j])[:, i < j])
        i, j = np.concatenate(found, axis=1)
        return pa.table({"i": i, "j": j})

    # elsewhere the smaller id is on the left where it is at home, and there alone
    return left.unionByName(right).groupBy("cell", "a", "b").applyInArrow(meet, "i long, j long")


def greedy_redundant(df: DataFrame, id_col: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """The ids that a keep-first pass drops: a row goes where an earlier kept row is as similar as the threshold.

    Of equal vectors only the first is compared; the others go with it or because of it. Each round settles the rows whose earlier neighbours are all
    settled, one at least; there are as many as the longest chain. What a round drops is a table of its own, and the pairs that are
    left replace those before.
    """
    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    firsts = written(keyed.groupBy("v").agg(F.min("id").alias("id")), "firsts")
    alike = F.lit(threshold <= 0) | (F.lit(threshold <= 1) & F.exists("v", lambda x: x != 0))
    copies = keyed.where(alike).join(firsts.select("id"), "id", "left_anti").select("id")
    open_ = written(similar_pairs(firsts, "id", "v", threshold), "pairs")
    gone = [written(copies, "gone")]
    while open_.limit(1).count():
        waiting = open_.select(F.col("j").alias("id")).distinct()
        kept = open_.select(F.col("i").alias("id")).distinct().join(waiting, "id", "left_anti")
        dropped = written(open_.join(kept.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct(), "gone")
        gone.append(dropped)
        left = open_.join(dropped.withColumnRenamed("id", "i"), "i", "left_anti").join(dropped.withColumnRenamed("id", "j"), "j", "left_anti")
        open_ = written(left.join(kept.withColumnRenamed("id", "i"), "i", "left_anti"), "open")
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("id", id_col)
