"""Packing of documents into sequences by the sum-of-squares rule.

A document longer than a sequence is cut into full pieces and a rest; full pieces are sequences of their own. The
pieces are dealt by a hash of what they are into groups of about ``group`` documents (equal rows, which nothing tells apart, by their count), so
that sequences never hang on partitions, and each group is packed by itself, longest first:
a piece goes to the open sequence where the sum, over all gaps, of the squared number of open sequences with that gap
becomes smallest; a new sequence is opened only where none has room, as few sequences are wanted. So a group ends with
a few open sequences at most, and no task sees more than a group.

Cases: a null or empty text is a piece of the end token alone; documents may repeat (each row is packed); ties go to
the smallest gap, and pieces of equal length are taken by doc_id and piece, null first; an empty table gives an empty
result; columns may have any other names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

#: Equal rows that are made again at once.
COPIES = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: PIECES, and the ids themselves if wanted."""
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            doc_id, done = batch.column(0), 0
            for flat, at in enc.ids(batch.column(1)):
                out: list[list] = [[] for _ in range(4 + with_ids)]
                whole = doc_id.slice(done, len(at) - 1)
                done += len(at) - 1
                owner = []
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                    ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        owner.append(k)
                        values = (piece, start, len(part), zlib.crc32(part.tobytes()))
                        for column, x in zip(out, values + ((part.astype(np.int64),) if with_ids else ()), strict=True):
                            column.append(x)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [whole.take(pa.array(owner, pa.int64())), *[pa.array(x, t) for x, t in zip(out, kinds, strict=False)]],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text")).mapInArrow(cut, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there, for pieces in the order in which they are placed."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for k, size in enumerate(sizes.tolist()):
        now = count[size:]
        # what the sum of squares gains where a sequence of gap g = size + i becomes one of gap i; a full one leaves it
        gain = 2 * (count[: len(now)] - now) + 2
        if len(gain):
            gain[0] = 1 - 2 * now[0]
        gain[now == 0] = 1 << 60
        i = int(gain.argmin())
        if now[i]:
            gap = size + i
            one = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, one = capacity, opened
            opened += 1
        sequence[k], offset[k] = one, capacity - gap
        if gap > size:
            open_by_gap[gap - size].append(one)
            count[gap - size] += 1
    return sequence, offset


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, group: int = 4096, with_ids: bool = False) -> DataFrame:
    """PIECES, with sequence_id and offset, and the ids if wanted."""
    groups = max(1, -(-docs.count() // group))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = PIECES + ", ids array<long>" * with_ids + ", sequence_id long, offset long"

    def packed(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], na_position="first", kind="stable")
        size = x["length"].to_numpy()
        full = int((size == capacity).sum())
        sequence, offset = sum_of_squares(size[full:], capacity)
        x["sequence_id"] = np.concatenate([np.arange(full), full + sequence]) + (int(key[0]) << 32)
        x["offset"] = np.concatenate([np.zeros(full, np.int64), offset])
        return x[[*columns, "sequence_id", "offset"]]

    found = pieces(docs, path, capacity, end_id, with_ids).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    # equal rows once each, some thousands at a time
    runs = found.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * COPIES, F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1))).drop("n", "run")
    group_of = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(groups))
    return each.withColumn("group", group_of).groupBy("group").applyInPandas(packed, schema)
