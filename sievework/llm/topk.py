"""Exact top-k by inner product, with a table of pivots.

Integer vectors are mapped so that the largest inner products are the smallest distances: a candidate x gets one more
component, sqrt(M - |x|^2) for M the largest squared norm, and a query a zero. Candidates are kept in blocks, each with a table of its
distances to many pivots, which is made once. For a query, the largest difference of its own and a candidate's distance to a
pivot is a lower bound of their distance. Candidates are evaluated in the order of that bound, some at a time, until the bound of the
next is above the distance of the k-th best: then none of the rest can be among the best. Scores are exact integers;
bounds are lowered by more than their rounding error.

The queries are a stated set of rows, held against all rows in blocks. A task holds as many blocks of candidates as fit in memory, and each block of
queries is sent to each task once: it meets one block of candidates after the other, with the best k so far. So queries are sent as often as
tasks' memories are filled by all candidates, and each meeting gives at most k rows for each query, of which the best k are kept.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors end in zeros; vectors of no
component score 0; ids may repeat (each row is a candidate, and a query is never matched with rows of its own id; equal rows are one
query, and different vectors of one id are queries of their own); a null id takes no part; ties go to the smaller id; fewer than k
candidates give all; an empty table gives none; components of 2**54 or more after scaling, and scores beyond 64 bits, are errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """id and v, the floors of scale times each component, of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 54), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.transform(v, whole).alias("v"))


def matrix(vectors, width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m


def raised(m: np.ndarray, most: float | None) -> np.ndarray:
    """The vectors with one more component: a candidate's, or 0 for queries (most is None)."""
    x = m.astype(float)
    last = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most - (x**2).sum(1), 0))
    return np.hstack([x, last[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row for each pivot, as 32-bit floats."""
    square = (pivots**2).sum(1)[:, None] + (x**2).sum(1) - 2 * pivots @ x.T
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


#: Bytes of the blocks of candidates that a task holds.
MOST_HELD = 1 << 26
#: A block: its ids, its vectors one after the other as 64-bit integers, and its distances to the pivots.
BLOCK = "block int, ids binary, m binary, distances binary"


def blocks(rows: DataFrame, number: Column, width: int, pivots: np.ndarray, most: float | None) -> DataFrame:
    def packed(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id", kind="stable")
        m = matrix(x["v"], width)
        table = distances(raised(m, most), pivots)
        return pd.DataFrame({"block": [key[0]], "ids": [x["id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()], "distances": [table.tobytes()]})

    return rows.withColumn("block", number).groupBy("block").applyInPandas(packed, BLOCK)


def exactly(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit floats where no inner product of them can reach 2**52, so that it is exact; as they are, where it fits 64 bits; else as Python's integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = float if largest < 2**52 else np.int64 if largest < 2**62 else object
    return a.astype(kind), b.astype(kind)


def best(
    q_ids, q, q_table, c_ids, c, c_table, most: float, k: int, chunk: int = 512, start: list[tuple[np.ndarray, np.ndarray]] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For one block of each: the place of the query, the candidate's id and the score of the k best for each query; and how many were evaluated.

    The tables have a row for each pivot. start: ids and scores of each query's best of other blocks, which count among the k and stop it sooner.
    """
    asked, exact = exactly(q, c)
    norms = (q.astype(float) ** 2).sum(1)
    slack = 1e-5 * np.sqrt(1.0 + most + norms.max(initial=0.0))  # above the rounding of roots of differences of squares, and of 32-bit floats
    out_q, out_c, out_s, evaluated = [], [], [], 0
    for i in range(len(q)):
        bound = np.zeros(len(c), np.float32)
        for column, own in zip(c_table, q_table[:, i], strict=True):
            np.maximum(bound, np.abs(column - own), out=bound)
        ids, scores = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if start is None else start[i]
        # the distance of the k-th best; a candidate must come nearer, or as near with a smaller id
        reach = lambda scores, i=i: np.sqrt(max(norms[i] + most - 2 * float(scores[-1]), 0.0)) + 2 * slack if len(scores) == k else np.inf
        # in the order of the bound: first the few lowest, then those of the rest that can still be among the best
        lowest = np.argpartition(bound, chunk)[:chunk] if len(bound) > chunk else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[lowest] = False
        some, order = lowest[bound[lowest] <= reach(scores)], None
        while len(some):
            evaluated += len(some)
            new = (exact[some] @ asked[i]).astype(np.int64)
            near = c_ids[some] != q_ids[i]
            if len(scores) == k:
                near &= new >= scores[-1]
            elif np.count_nonzero(near) > k:
                near &= new >= np.partition(new[near], -k)[-k]
            ids, scores = np.concatenate([ids, c_ids[some][near]]), np.concatenate([scores, new[near]])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            kth = reach(scores)
            if order is None:
                order = np.flatnonzero(rest & (bound <= kth))
                order = order[np.argsort(bound[order], kind="stable")]
            order = order[: np.searchsorted(bound[order], kth, "right")]
            step = len(some)
            some, order = order[: 2 * step], order[2 * step :]
        out_q.append(np.full(len(ids), i))
        out_c.append(ids)
        out_s.append(scores)
    none = np.zeros(0, np.int64)
    return *(np.concatenate(x) if x else none for x in (out_q, out_c, out_s)), evaluated


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int = 32, per_block: int = 4096, queries_per_block: int = 512
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each query; is_query is over the column id."""
    with shared.Workspace(vectors.sparkSession, "topk") as work:
        return shared.written(_search(vectors, is_query, k, scale, pivots, per_block, queries_per_block, work), "best")


def _search(vectors, is_query, k, scale, pivots, per_block, queries_per_block, work: shared.Workspace) -> DataFrame:
    rows = work.written(integers(vectors, scale), "integers")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("most")).first()
    width, most = max(ends["width"] or 0, 1), ends["most"] or 0.0
    chosen = rows.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(pivots).select("v").collect()
    points = raised(matrix([r["v"] for r in chosen], width), most)
    queries = rows.where(is_query).dropDuplicates(["id", "v"])
    n_c, n_q = max(1, -(-ends["n"] // per_block)), max(1, -(-queries.count() // queries_per_block))
    block = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    # a row may be there as often as it likes, so candidates are dealt by more than what they hold
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_c)).cast("int")
    at_once = max(1, MOST_HELD // (per_block * (8 * width + 4 * len(points) + 8)))
    tasks = max(-(-n_c // at_once), min(n_c, shared.parts(vectors.sparkSession)))
    held = work.written(blocks(rows, dealt, width, points, most), "candidates").withColumns({"task": F.pmod("block", F.lit(tasks)), "of": F.lit(-1)})
    asked = work.written(blocks(queries, block(n_q, "q"), width, points, None), "queries").withColumn("of", F.col("block"))
    asked = asked.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    together = held.unionByName(asked).repartition("task").sortWithinPartitions("task", "of", "block").select("task", "of", "ids", "m", "distances")

    def unpacked(ids: bytes, m: bytes, table: bytes):
        ids = np.frombuffer(ids, np.int64)
        return ids, np.frombuffer(m, np.int64).reshape(len(ids), width), np.frombuffer(table, np.float32).reshape(-1, len(ids))

    def meet(batches):
        now, candidates = None, []
        for batch in batches:
            for t, of, *parts in zip(*(batch.column(i) for i in range(5)), strict=True):
                t, of, parts = t.as_py(), of.as_py(), unpacked(*(x.as_py() for x in parts))
                if t != now:
                    now, candidates = t, []
                if of < 0:
                    candidates.append(parts)
                    continue
                start = None
                for some in candidates:
                    at, c, s, _ = best(*parts, *some, most, k, start=start)
                    ends = np.searchsorted(at, np.arange(len(parts[0]) + 1))
                    start = [(c[x:y], s[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
                if candidates:
                    columns = [parts[0][at], of + (at << 32), c, s]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "query", "vec_id", "score"])

    found = together.mapInArrow(meet, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
