"""Weighted sums of arrays by key, in Arrow batches: never a row for a component."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds before it gives them away.
MOST_HELD = 1 << 26


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length, as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def array_sums(df: DataFrame, keys: Sequence[str], value: str | Column, weight: Column | None = None) -> DataFrame:
    """keys, n (the sum of weights, 1 each by default) and total, the weighted sum of the arrays of each key, which must be of one length.

    Tasks sum up what they have of a key; partial sums of a key meet in one task, in order, where one of them at a time is added. Rows
    with a null array are left out.
    """
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    rows = df.select(*[F.col(k) for k in keys], (F.lit(1.0) if weight is None else weight.cast("double")).alias("n"), (F.col(value) if isinstance(value, str) else value).cast("array<double>").alias("total"))
    return added(rows.where(F.col("total").isNotNull()).mapInArrow(partial(len(keys)), ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "n double, total array<double>"])), keys)


def partial(n_keys: int):
    """Of rows of keys, weight and array: sums by key, of the rows of a task as far as memory goes."""

    def run(batches: Iterator[pa.RecordBatch]):
        n: dict[tuple, float] = {}
        total: dict[tuple, np.ndarray] = {}

        def give(names: list[str], kinds: list[pa.DataType]):
            for lo in range(0, len(total), 1000):
                some = list(total)[lo : lo + 1000]
                columns = [pa.array([k[i] for k in some], kinds[i]) for i in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n[k] for k in some]), pa.array([total[k].tolist() for k in some], pa.list_(pa.float64()))], names)
            n.clear()
            total.clear()

        names, kinds = [], []
        for b in batches:
            names, kinds = b.schema.names, b.schema.types
            if not b.num_rows:
                continue
            x, w = matrix(b.column(n_keys + 1)), b.column(n_keys).to_numpy(zero_copy_only=False)
            if n_keys:
                number: dict[tuple, int] = {}
                at = np.array([number.setdefault(k, len(number)) for k in zip(*[b.column(i).to_pylist() for i in range(n_keys)], strict=True)])
            else:
                number, at = {(): 0}, np.zeros(len(x), np.int64)
            order = np.argsort(at, kind="stable")
            begin = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums, weights = np.add.reduceat(x[order] * w[order][:, None], begin), np.add.reduceat(w[order], begin)
            for k, s, v in zip(number, sums, weights, strict=True):
                total[k] = total[k] + s if k in total else s
                n[k] = n.get(k, 0.0) + float(v)
            if 8 * x.shape[1] * len(total) > MOST_HELD:
                yield from give(names, kinds)
        if total:
            yield from give(names, kinds)

    return run


def added(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sums of partial ones: rows of keys, n and total."""
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]):
        key, n, total, names, kinds = None, 0.0, None, [], []

        def give():
            yield pa.RecordBatch.from_arrays([*[pa.array([k], kinds[i]) for i, k in enumerate(key)], pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names)

        for b in batches:
            names, kinds = b.schema.names, b.schema.types
            columns = [b.column(i).to_pylist() for i in range(n_keys)]
            for i in range(b.num_rows):
                this = tuple(c[i] for c in columns)
                x, w = b.column(n_keys + 1)[i].values.to_numpy(zero_copy_only=False), b.column(n_keys)[i].as_py()
                if this == key:
                    n, total = n + w, total + x
                    continue
                if key is not None:
                    yield from give()
                key, n, total = this, w, x.astype(float)
        if key is not None:
            yield from give()

    dealt = parts.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*[F.col(k) for k in keys]) if keys else parts.coalesce(1)  # without keys, a row for each task
    return dealt.mapInArrow(run, parts.schema)
