"""Clusters of samples and their representatives."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, norm
from ..sources.tables import Workspace, written
from . import sampling
from .array_sums import array_sums, matrix
from .graphs import connected
from .influence import nearest_of_cluster
from .pairs import GRID, block_rows, greedy_redundant, grid_parts, similar_pairs  # noqa: F401
from .scalars import beside_key


def default_clusters(n: int) -> int:
    return max(1, min(math.isqrt(n), n // 2))


def fit_clusters(df: DataFrame, vector: str, k: int, method: str = "kmeans", seed: int = 42, starts: int = 10) -> DataFrame:
    """df with cluster and center. kmeans keeps the cheapest of several starts; agglomerative is linkage()."""
    if method == "agglomerative":
        return linkage(df, vector, k=k)
    if method != "kmeans":
        raise ValueError(f"no such clustering method: {method!r}")
    features = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    models = [KMeans(k=k, seed=seed + s, featuresCol="__v", predictionCol="cluster").fit(features) for s in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    return model.transform(features).drop("__v").join(F.broadcast(centers), "cluster")


#: Clusters that one task joins, unless they are more than a block has.
CELL = 32_768
#: Digits to which similarities are rounded before they are compared, so that the order of additions does not matter.
DIGITS = 10
#: Rows and columns of a tile of similarities in single precision, and candidates that are worked out at once in double precision.
TILE, EXACT = (512, 512), 1 << 15
#: The similarity of near copies.
ALIKE = 0.9
JOINED = "kind int, a long, b long, s double, sum array<double>, n long, o long, near double"


class Nearest:
    """The nearest of each of some vectors (ids in order) among others, o, and its similarity s, rounded (-inf: none); of equally near ones the smallest id.
    Where ``above`` is given, what is no nearer than that may be left out. low is the smallest id of a near copy, or the vector's own.

    Tiles are of single precision, and only their largest values are kept. What may be the nearest by these, give or take their error, is worked out
    in double precision.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, above: np.ndarray | None = None, part: np.ndarray | None = None) -> None:
        self.ids, self.m, self.single, self.part = ids, m, m.astype(np.float32), part
        self.o, self.s, self.low = np.full(len(m), -1, np.int64), np.full(len(m), -np.inf), ids.copy()
        self.slack = 2 * (m.shape[1] + 4) * 2.0**-24 + 2 * 10.0**-DIGITS
        self.floor = np.full(len(m), -np.inf) if above is None else above - self.slack

    def settle(self, rows: slice, top: np.ndarray, tiles: list[slice], others: Nearest) -> None:
        """top: the largest similarity of some rows (the second axis) in each tile of the others."""
        floor, alike = np.maximum(self.floor[rows], top.max(0) - self.slack), top >= ALIKE
        first = np.where(alike.any(0), alike.argmax(0), -1)
        for t, columns in enumerate(tiles):
            at = rows.start + np.flatnonzero((top[t] >= floor) & (top[t] > -np.inf) | (first == t))
            if not len(at):
                continue
            near, least, ids = self.single[at] @ others.single[columns].T, floor[at - rows.start, None], others.ids[columns]
            near[self.same(at, others, columns)] = -np.inf
            copies = np.flatnonzero((near >= ALIKE).any(1))
            self.low[at[copies]] = np.minimum(self.low[at[copies]], ids[(near[copies] >= ALIKE).argmax(1)])
            x, y = np.nonzero((near >= least) & (near > -np.inf))
            if not len(x):
                continue
            exact = np.concatenate([self.exact(at[x[i : i + EXACT]], others.m[columns], y[i : i + EXACT]) for i in range(0, len(x), EXACT)])
            starts = np.flatnonzero(np.diff(x, prepend=-1))
            best, at = np.maximum.reduceat(exact, starts), at[x[starts]]
            k = np.flatnonzero(exact == np.repeat(best, np.diff(starts, append=len(x))))
            o = ids[y[k[np.diff(x[k], prepend=-1) > 0]]]
            nearer = (best > self.s[at]) | ((best == self.s[at]) & (o < self.o[at]))
            self.s[at], self.o[at] = np.where(nearer, best, self.s[at]), np.where(nearer, o, self.o[at])

    def same(self, rows: slice | np.ndarray, others: Nearest, columns: slice) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        """Where rows and columns are one vector, or of one part."""
        if self.part is not None:
            return self.part[rows, None] == others.part[None, columns]
        mine, theirs = self.ids[rows], others.ids[columns]
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        there = np.flatnonzero(theirs[at] == mine)
        return there, at[there]

    def exact(self, rows: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", self.m[rows], m[others]), DIGITS)


def meet(l: Nearest, r: Nearest, both: bool = False) -> None:
    """Looks for the nearest of l in r, and with ``both`` of r in l; a vector's nearest is not itself and, where parts are given, of another part."""
    if not len(l.ids) or not len(r.ids):
        return
    down, across = ([slice(i, min(i + size, len(x.ids))) for i in range(0, len(x.ids), size)] for x, size in zip((l, r), TILE, strict=True))
    tile, low = np.empty(TILE, np.float32), np.empty((len(down) if both else 0, len(r.ids)), np.float32)
    for i, rows in enumerate(down):
        top = np.empty((len(across), rows.stop - rows.start), np.float32)
        for j, columns in enumerate(across):
            near = np.matmul(l.single[rows], r.single[columns].T, out=tile[: rows.stop - rows.start, : columns.stop - columns.start])
            near[l.same(rows, r, columns)] = -np.inf
            near.max(1, out=top[j])
            if both:
                near.max(0, out=low[i, columns])
        l.settle(rows, top, across, r)
    for columns in across if both else []:
        r.settle(columns, low[:, columns], down, l)


def mutual(sums: np.ndarray, size: np.ndarray, least: float, outside: np.ndarray | None = None) -> tuple[list[tuple[int, int, float]], dict[str, np.ndarray]]:
    """The joins of some clusters (in the order of their ids) above a similarity, by position: (into, which, similarity), the smaller one into which the other
    goes. And the clusters that are left: at, sums and size; whether they are joined ones; the nearest, o, and its similarity, s. Where o is -1, none is
    nearer than s, if any is.

    Pairs that are each other's nearest are joined, round by round; of equally near ones the smaller id is the nearest, so that there is always such a pair.
    With ``outside``, the similarity to the nearest of all others, only what is nearer than that is joined, whatever is joined among the others: a mean is
    no more than the largest of its terms. A joined cluster's nearest outside is no nearer than the mean of its two sides'.

    What is no nearer than that bound is not looked for, so after the first round few clusters are compared with all.
    """
    sums, size, n, out = sums.astype(float), size.astype(float), len(size), []
    m, outside = sums / size[:, None], np.full(n, -np.inf) if outside is None else outside.astype(float)
    bound, alive, joined = np.maximum(outside, least), np.ones(n, bool), np.zeros(n, bool)
    o, s, ask = np.full(n, -1), np.full(n, np.inf), np.arange(n)
    while True:
        live = np.flatnonzero(alive)
        found = Nearest(ask, m[ask], bound[ask])
        meet(found, Nearest(live, m[live]))
        o[ask], s[ask] = found.o, found.s
        k = live[o[live] >= 0]
        a = k[(o[o[k]] == k) & (k < o[k]) & (s[k] > np.maximum(bound[k], bound[o[k]]))]
        if not len(a):
            break
        b = o[a]
        out += zip(a.tolist(), b.tolist(), s[a].tolist(), strict=True)
        outside[a] = (size[a] * outside[a] + size[b] * outside[b]) / (size[a] + size[b]) + 10 * 10.0**-DIGITS
        sums[a] += sums[b]
        size[a] += size[b]
        m[a], bound[a] = sums[a] / size[a, None], np.maximum(outside[a], least)
        alive[b], joined[a] = False, True
        ends = np.zeros(n + 1, bool)
        ends[a] = ends[b] = True
        gone = alive & (ends[:n] | ends[o])
        o[gone] = -1
        ask = np.flatnonzero(gone & (s > bound))
    return out, {"at": live, "sums": sums[live], "size": size[live].astype(np.int64), "joined": joined[live], "o": o[live], "s": s[live]}


def joined_in_tasks(parts: DataFrame, least: float) -> DataFrame:
    """JOINED: rows of kind 0 are joins, rows of kind 1 the clusters (a, sum, n) that are left, of clusters (part, c, sum, n, o, s) part by part. o and s are the
    nearest of all clusters out of the part (s -inf: there is none). A cluster that is left has its nearest of all clusters, o and near, unless
    it is a joined one or that is not known; o may be joined in its own part."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("c")
        ids, others, outside = x["c"].to_numpy(), x["o"].to_numpy(), x["s"].to_numpy()
        joins, left = mutual(np.stack(x["sum"]), x["n"].to_numpy(), least, outside)
        at, o, s = left["at"], left["o"], left["s"]
        inside = o >= 0
        mine, theirs = ids[o], others[at]
        first = inside & ((s > outside[at]) | ((s == outside[at]) & (mine < theirs)))
        known = ~left["joined"] & (inside | (outside[at] > s))
        into, which, near = zip(*joins, strict=True) if joins else ((), (), ())
        n, m, none = len(joins), len(at), lambda k: [None] * k
        return pd.DataFrame({
            "kind": [0] * n + [1] * m, "a": [*ids[list(into)].tolist(), *ids[at].tolist()], "b": pd.array([*ids[list(which)].tolist(), *none(m)], "Int64"),
            "s": pd.array([*near, *none(m)], "Float64"), "sum": [*none(n), *left["sums"]], "n": pd.array([*none(n), *left["size"].tolist()], "Int64"),
            "o": pd.array([*none(n), *np.where(known, np.where(first, mine, theirs), None).tolist()], "Int64"),
            "near": pd.array([*none(n), *np.where(known, np.where(first, s, outside[at]), None).tolist()], "Float64"),
        })

    return parts.groupBy("part").applyInPandas(run, JOINED)


def joined_in_tables(clusters: DataFrame, edges: DataFrame, least: float, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """The same by joins of tables, for parts that are too large for a task: the joins, round by round, and the clusters that are left. edges: a, b of
    all clusters above the similarity, so that a joined cluster's are those of its two sides."""
    joins = []
    side = lambda name: clusters.select(F.col("c").alias(name), F.col("sum").alias(f"{name}_sum"), F.col("n").alias(f"{name}_n"))
    while True:
        near = edges.join(side("a"), "a").join(side("b"), "b")
        near = near.select("a", "b", F.round(dot(F.col("a_sum"), F.col("b_sum")) / (F.col("a_n") * F.col("b_n")), DIGITS).alias("s")).where(F.col("s") > least)
        near = work.written(near, "near")
        both = near.select(F.col("a").alias("c"), F.col("b").alias("o"), "s").unionByName(near.select(F.col("b").alias("c"), F.col("a").alias("o"), "s"))
        nearest = both.groupBy("c").agg(F.min(F.struct((-F.col("s")).alias("s"), "o")).alias("m")).select("c", "m.o", (-F.col("m.s")).alias("s"))
        back = nearest.select(F.col("o").alias("c"), F.col("c").alias("o"))
        pairs = work.written(nearest.join(back, ["c", "o"]).where("c < o").select(F.col("c").alias("a"), F.col("o").alias("b"), "s"), "pairs")
        if not pairs.limit(1).count():
            return joins, clusters
        joins.append(pairs)
        clusters = work.written(joined_sums(clusters, pairs), "clusters")
        to = pairs.select(F.col("b").alias("was"), F.col("a").alias("now"))
        for name in ("a", "b"):
            near = near.join(to.withColumnRenamed("was", name), name, "left").withColumn(name, F.coalesce("now", name)).drop("now")
        edges = work.written(near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def mean() -> Column:
    return F.transform("sum", lambda x: x / F.col("n")).alias("v")


def nearest(some: DataFrame, n_some: int, clusters: DataFrame, n: int) -> DataFrame:
    """c of some clusters, o and s: the nearest other cluster (where both have a part, of another part), of equally near ones the smallest, and its similarity.
    Blocks meet blocks; of each two no more than a row for a cluster is left, so that no pair is ever stored."""
    dims, part = dimensions(clusters), ["part"] if "part" in clusters.columns else []
    a, b = blocks(n_some, dims, GRID // 2), blocks(n, dims)
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asks = some.select(by_hash(a).alias("a"), every(b).alias("b"), F.lit(True).alias("left"), *part, "c", mean())
    told = clusters.select(every(a).alias("a"), by_hash(b).alias("b"), F.lit(False).alias("left"), *part, "c", mean())
    return nearest_of_blocks(asks.unionByName(told), False).select("c", "o", "s")


def nearest_of_all(clusters: DataFrame, n: int) -> DataFrame:
    """The same of all clusters, and low, the smallest of those as near as near copies, and of itself. Two blocks meet once."""
    parts = blocks(n, dimensions(clusters))
    met = clusters.select(by_hash(parts).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("with"), "c", mean())
    return nearest_of_blocks(met.select(F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), (F.col("block") <= F.col("with")).alias("left"), "c", "v"), True)


def mean() -> Column:
    return F.transform("sum", lambda x: x / F.col("n")).alias("v")


def dimensions(clusters: DataFrame) -> int:
    return clusters.select(F.max(F.size("sum"))).first()[0] or 1


def blocks(n: int, dims: int, most: int = GRID) -> int:
    """Blocks of n vectors: few, as a vector is sent for each, unless they would be larger than two blocks of pairs.py."""
    return max(min(grid_parts(n, dims), most), -(-n // (2 * block_rows(dims))))


def by_hash(parts: int) -> Column:
    return F.pmod(F.xxhash64("c", F.lit("block")), F.lit(parts)).cast("int")


def nearest_of_blocks(rows: DataFrame, both: bool) -> DataFrame:
    """c, o, s, low of rows (a, b, left, part or none, c, v): of those on the left among those on the right of the same a and b. With ``both``, of all among
    those on the other side, and where a is b, of all among all, which are on the left."""

    def side(x: pa.Table) -> Nearest:
        order = np.argsort(x.column("c").to_numpy(), kind="stable")
        part = x.column("part").to_numpy()[order] if "part" in x.column_names else None
        return Nearest(x.column("c").to_numpy()[order], matrix(x.column("v").combine_chunks())[order], part=part)

    def run(x: pa.Table) -> pa.Table:
        l = side(x.filter(pc.field("left")))
        if both and x.column("a")[0].as_py() == x.column("b")[0].as_py():
            meet(l, l)
            sides = [l]
        else:
            r = side(x.filter(~pc.field("left")))
            meet(l, r, both)
            sides = [l, r] if both else [l]
        there = np.concatenate([x.s for x in sides]) > -np.inf
        return pa.table({name: np.concatenate([getattr(x, at) for x in sides])[there] for name, at in (("c", "ids"), ("o", "o"), ("s", "s"), ("low", "low"))})

    met = rows.groupBy("a", "b").applyInArrow(run, "c long, o long, s double, low long")
    found = met.groupBy("c").agg(F.min(F.struct((-F.col("s")).alias("s"), "o")).alias("m"), F.min("low").alias("low"))
    return found.select("c", "m.o", (-F.col("m.s")).alias("s"), "low")


def joined_copies(clusters: DataFrame, near: DataFrame, n: int, most: int, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The joins among near copies (as nearest_of_all() gives them) that nothing outside can come before, the clusters that are left, and near of those
    of them whose nearest is known; None if there are no groups of three or more, and no more than a task joins.

    In such a group one cluster grows and all others wait for it, so a join or two come of a round. A task joins a group as long as nothing outside of it
    is nearer, which is why its members, and they alone, are compared with all again.
    """
    sizes = near.groupBy(F.col("low").alias("part")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(3, most)).select("part")
    part = work.written(near.select("c", F.col("low").alias("part")).join(sizes, "part", "left_semi"), "copies")
    some = part.count()
    if not some:
        return None
    placed = work.written(clusters.join(part, "c", "left").select("c", "sum", "n", F.coalesce("part", "c").alias("part"), F.col("part").isNotNull().alias("copy")), "placed")
    members = placed.where("copy").drop("copy")
    outside = work.written(nearest(members, some, placed, n), "outside")
    beside = members.join(outside, "c", "left").select("part", "c", "sum", "n", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("s", F.lit(-math.inf)).alias("s"))
    found = work.written(joined_in_tasks(beside, -2.0), "joined")
    joins, left = found.where("kind = 0").select("a", "b", "s"), found.where("kind = 1")
    rest = placed.where("not copy").select("c", "sum", "n").unionByName(left.select(F.col("a").alias("c"), "sum", "n"))
    known = left.where("o is not null").select(F.col("a").alias("c"), "o", F.col("near").alias("s"))
    known = near.join(part, "c", "left_anti").select("c", "o", "s").unionByName(known)
    return joins, work.written(rest, "clusters"), work.written(unjoined(known, joins), "stays")


def joined_by_nearest(clusters: DataFrame, most: int, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """The joins of pairs that are each other's nearest, round by round, until there are ``most`` clusters or fewer; and these. Those of near copies come first.

    A joined cluster is no nearer to any other than the nearer one of its two was. So what was a cluster's nearest stays it as long as neither is
    joined, and a round compares only the others with all.
    """
    n, joins = clusters.count(), []
    first = work.written(nearest_of_all(clusters, n), "nearest")
    stays = first.select("c", "o", "s")
    if found := joined_copies(clusters, first, n, most, work):
        copies, clusters, stays = found
        joins.append(copies)
        n -= copies.count()
    while n > most:
        held = stays.count()
        near = stays
        if held < n:
            near = work.written(stays.unionByName(nearest(clusters.join(stays, "c", "left_anti"), n - held, clusters, n)), "near")
        back = near.select(F.col("o").alias("c"), F.col("c").alias("o"))
        pairs = work.written(near.where("c < o").join(back, ["c", "o"]).select(F.col("c").alias("a"), F.col("o").alias("b"), "s"), "pairs")
        joined = pairs.count()
        if not joined:
            if not held:
                break
            stays = near.limit(0)  # ties by rounding
            continue
        joins.append(pairs)
        n -= joined
        clusters, stays = work.written(joined_sums(clusters, pairs), "clusters"), work.written(unjoined(near, pairs), "stays")
    return joins, clusters


def unjoined(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (c, o, s) of which neither cluster is of the pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"))
    return near.join(ends, "c", "left_anti").join(ends.withColumnRenamed("c", "o"), "o", "left_anti").select("c", "o", "s")


def joined_sums(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """The clusters (c, sum, n) when those of the pairs (a, b) are joined. Only these are moved."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), "a")
    moved = clusters.join(ends, "c").select(F.col("c").alias("was"), F.col("a").alias("c"), "sum", "n")
    added = moved.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("was", "sum"))).alias("x"), F.sum("n").alias("n"))  # two of a pair
    added = added.select("c", F.zip_with(F.get("x.sum", F.lit(0)), F.get("x.sum", F.lit(1)), lambda u, v: u + v).alias("sum"), "n")
    return clusters.join(ends, "c", "left_anti").select("c", "sum", "n").unionByName(added)


def joined_level(clusters: DataFrame, least: float, cell: int, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """The joins above a similarity, and the clusters (c, sum, n) that are left."""
    kept, whole = [], clusters.count() <= cell
    alone = lambda parts: parts.select("part", "c", "sum", "n", F.lit(0).cast("long").alias("o"), F.lit(-math.inf).alias("s"))
    if whole:
        found = work.written(joined_in_tasks(alone(clusters.withColumn("part", F.lit(0))), least), "joined")
        edges = None
    else:
        edges = work.written(similar_pairs(clusters, "c", "sum", least).select(F.col("i").alias("a"), F.col("j").alias("b")), "edges")
        part = work.written(connected(edges, work), "parts")
        size = part.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        placed = work.written(clusters.join(beside_key(part, size, "part"), "c", "left"), "placed")
        kept.append(placed.where("part is null").select("c", "sum", "n"))
        found = work.written(joined_in_tasks(alone(placed.where(F.col("size") <= cell)), least), "joined")
    joins = [found.where("kind = 0").select("a", "b", "s")]
    kept.append(found.where("kind = 1").select(F.col("a").alias("c"), "sum", "n"))
    if edges is not None and (large := placed.where(F.col("size") > cell).select("c", "sum", "n")).limit(1).count():
        more, left = joined_in_tables(large, edges.join(large.select(F.col("c").alias("a")), "a", "left_semi"), least, work)
        joins, kept = joins + more, [*kept, left]
    return joins, work.written(functools.reduce(DataFrame.unionByName, kept), "clusters")


def linkage(df: DataFrame, vector: str, k: int | None = None, threshold: float = 0.95, cell: int = CELL) -> DataFrame:
    """df with cluster and center (the mean of its vectors): average linkage by the cosine distance, exact at any size, to k clusters or above a similarity of
    ``threshold``.

    The mean similarity of two clusters is the inner product of their sums of unit vectors over the product of their sizes. Two that are each other's nearest
    can be joined whatever happens elsewhere, so all such pairs are joined round by round.

    To k clusters, a round looks for the nearest of the clusters whose nearest is gone, block against block, which stores no pair; one task joins the last
    ``cell`` clusters by a matrix. The last joins are taken back, by similarity, until there are k clusters.

    Above a threshold, clusters are joined over the graph of pairs above it, as a mean above t has a member above t; its connected parts are apart, and
    one task joins a part of up to ``cell`` clusters by a matrix.

    Equal vectors are always together, zero ones too, which have a similarity of 0 to all; null vectors make a cluster each row's
    value, null.
    """
    key = F.xxhash64(F.transform(vector, lambda x: x.cast("double") + 0.0))
    rows = df.withColumn("__c", key)
    with Workspace(df.sparkSession, "linkage") as work:
        length = F.greatest(norm(F.col(vector)), F.lit(1e-12))
        units = rows.where(F.col(vector).isNotNull()).groupBy("__c").agg(F.first(vector).alias("v"), F.first(length).alias("l"), F.count(F.lit(1)).alias("n"))
        first = work.written(units.select(F.col("__c").alias("c"), F.transform("v", lambda x: x.cast("double") / F.col("l") * F.col("n")).alias("sum"), "n"), "classes")
        classes, clusters, joins = first.count(), first, []
        cell = min(cell, block_rows(dimensions(first)))
        if k is not None and classes > cell:
            joins, clusters = joined_by_nearest(clusters, cell, work)
        more, clusters = joined_level(clusters, threshold if k is None else -2.0, cell, work)
        joins += more
        done = functools.reduce(DataFrame.unionByName, joins)
        if k is not None and classes - k < done.count():
            done = sampling.first_rows(work.written(done, "joins"), max(0, classes - k), -F.col("s"), "b")
        links = work.written(done.select(F.col("b").alias("c"), F.col("a").alias("root")), "links")
        while True:  # each step doubles how far a link reaches
            further = links.select(F.col("c").alias("root"), F.col("root").alias("next"))
            longer = work.written(links.join(further, "root", "left").select("c", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "links")
            links = longer.select("c", "root")
            if not longer.where("went").limit(1).count():
                break
        roots = written(first.select("c").join(links, "c", "left").select(F.col("c").alias("__c"), F.coalesce("root", "c").alias("cluster")), "roots")
    found = beside_key(rows, roots, "__c").drop("__c")
    sums = array_sums(found, ["cluster"], vector)
    return beside_key(found, sums.select("cluster", F.transform("total", lambda x: x / F.col("n")).alias("center")), "cluster")


def representatives(clustered: DataFrame, id_col: str, vector: str) -> DataFrame:
    """The member of each cluster that is nearest to its center by the cosine; ties by id."""
    distance = F.round(1 - cosine(F.col(vector), F.col("center")), 9)
    return nearest_of_cluster(clustered.withColumn("distance", distance), "cluster", "distance", id_col)
