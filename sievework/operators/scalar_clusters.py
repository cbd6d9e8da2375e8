"""k-means of one number, exact: clusters are ranges of values, so the best cuts are found by dynamic programming over a weighted histogram.

A bin of the histogram has one value, or so few rows that it does not matter much: bins are ranges of the numbers' bits, and those with more than their share
of the rows are parted again by the next bits. So bins are the same for any partitions, and few however many rows there are; with no more than BINS
values each has its own, and the clusters are the best there are. Of a cluster's cuts the best one moves right as the range grows, so each
of the k steps looks at few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram, about, and the bits that part a bin.
BINS, BITS = 4096, 12


def ordered(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits without a sign in the order of x, 0.0 and -0.0 as one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> np.ndarray:
    """Rows of least and greatest value, count, sum and sum of squares of each bin, in order. Nulls and NaN are in none."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    done, open_, depth, rows, shift = [], np.zeros(1, np.uint64), 0, None, np.uint64(0)
    while len(open_):
        first, depth, before, up = not depth, min(64, depth + BITS), open_, shift
        shift = np.uint64(64 - depth)

        def run(batches: Iterator[pa.RecordBatch], before=before, shift=shift, up=up, first=first):
            held: list[np.ndarray] = []
            for b in batches:
                x = b.column(0).to_numpy(zero_copy_only=False)
                code = ordered(x)
                if not first:
                    inside = np.isin(code >> up, before)
                    x, code = x[inside], code[inside]
                part = code >> shift
                held.append(summed(part, np.stack([x, x, np.ones(len(x)), x, x * x], axis=1)))
                if sum(map(len, held)) > 200_000:
                    held = [merged(held)]
            if held:
                found = merged(held)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].view(np.int64)), *[pa.array(found[:, k]) for k in range(1, 6)]], ["part", "low", "high", "n", "s", "q"])

        kind = "part long, low double, high double, n double, s double, q double"
        found = values.mapInArrow(run, kind).groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("n", "s", "q")]).toPandas()
        rows = found["n"].sum() if rows is None else rows
        large = (found["n"] > rows / bins) & (found["low"] < found["high"]) & (depth < 64)
        done.append(found[~large][["low", "high", "n", "s", "q"]].to_numpy(float))
        open_ = np.sort(found[large]["part"].to_numpy(np.int64).view(np.uint64))
    out = np.concatenate(done) if done else np.zeros((0, 5))
    return out[np.argsort(out[:, 0], kind="stable")]


def summed(part: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The bits of part, and of x least, greatest and sums by part."""
    order = np.argsort(part, kind="stable")
    part, x = part[order], x[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros((0, 6))
    columns = [part[at].view(np.float64), np.minimum.reduceat(x[:, 0], at), np.maximum.reduceat(x[:, 1], at), *[np.add.reduceat(x[:, k], at) for k in (2, 3, 4)]]
    return np.stack(columns, axis=1)


def merged(held: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(held)
    return summed(np.ascontiguousarray(both[:, 0]).view(np.uint64), both[:, 1:])


def best_cuts(bins: np.ndarray, k: int) -> np.ndarray:
    """The first bin of each of k clusters (of all bins, if there are fewer) with the least sum of squared distances to the means."""
    m = len(bins)
    k = min(k, m)
    if not k:
        return np.zeros(0, np.int64)
    middle = bins[:, 3].sum() / bins[:, 2].sum()
    # sums around the middle, so that squares do not cancel
    s, n = bins[:, 3] - middle * bins[:, 2], bins[:, 2]
    q = bins[:, 4] - 2 * middle * bins[:, 3] + middle * middle * bins[:, 2]
    n, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of bins i to j - 1 as one cluster."""
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(n[j] - n[i], 1e-300), 0.0)

    best = cost(np.zeros(m + 1, np.int64), np.arange(m + 1))
    best[0] = 0.0
    cuts = np.zeros((k, m + 1), np.int32)
    for c in range(1, k):
        # the best cut of each end from c + 1 on, halves at a time: it lies between those of the ends at both sides
        now, cut = np.full(m + 1, np.inf), cuts[c]
        todo = [(np.array([c + 1]), np.array([m]), np.array([c]), np.array([m - 1]))] if c + 1 <= m else []
        while todo:
            lo, hi, left, right = todo.pop()
            mid = (lo + hi) // 2
            stop = np.minimum(right, mid - 1)
            size = stop - left + 1
            begin = np.cumsum(size) - size
            of = np.repeat(np.arange(len(mid)), size)
            at = left[of] + np.arange(size.sum()) - begin[of]
            total = best[at] + cost(at, mid[of])
            least = np.minimum.reduceat(total, begin)
            where = np.flatnonzero(total == least[of])
            first = where[np.searchsorted(of[where], np.arange(len(mid)))]
            now[mid], cut[mid] = least, at[first]
            below, above = mid > lo, mid < hi
            parts = [(lo[below], mid[below] - 1, left[below], cut[mid[below]]), (mid[above] + 1, hi[above], cut[mid[above]], right[above])]
            both = tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
            if len(both[0]):
                todo.append(both)
        best = now
    out, end = [], m
    for c in range(k - 1, -1, -1):
        out.append(int(cuts[c][end]))
        end = out[-1]
    return np.array(out[::-1])


def scalar_kmeans(df: DataFrame, column: str, k: int, bins: int = BINS) -> DataFrame:
    """df with cluster, numbered from 0 in the order of values, and center, its mean. Nulls and NaN have a null cluster."""
    found = histogram(df, column, max(bins, 2 * k))
    cuts = best_cuts(found, k)
    stops = np.append(cuts[1:], len(found)).astype(np.int64)
    tops = [float(found[b - 1, 1]) for b in stops] if len(found) else []
    centers = [float(found[a:b, 3].sum() / found[a:b, 2].sum()) for a, b in zip(cuts, stops, strict=True)] if len(found) else []

    @F.arrow_udf("int")
    def place(x: pa.Array) -> pa.Array:
        v = x.to_numpy(zero_copy_only=False).astype(float)
        none = np.isnan(v)
        return pa.array(np.searchsorted(tops, np.where(none, -math.inf, v), "left").astype(np.int32), mask=none)

    center = F.get(F.array(*map(F.lit, centers)), F.col("cluster")) if centers else F.lit(None).cast("double")
    return df.withColumn("cluster", place(F.col(column).cast("double")) if centers else F.lit(None).cast("int")).withColumn("center", center)
