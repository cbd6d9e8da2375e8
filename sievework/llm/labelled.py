"""A bounded sample of labelled texts to fit a model on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: A text that is longer than its share is taken as so many pieces.
PIECES = 64


def excerpt(text: Column, most: int) -> Column:
    """The text; of one of more than ``most`` bytes, pieces of equal length at even distances, from its begin to its end."""
    length, piece = F.length(text).cast("long"), max(1, most // PIECES)
    at = lambda i: F.floor(i * (length - piece) / (PIECES - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(text, at(i), F.lit(piece)))
    return F.when((F.octet_length(text) > most) & (length > piece), F.array_join(pieces, " ")).otherwise(text)


def sample(docs: DataFrame, marks: DataFrame, most: Mapping[int, int], most_bytes: int) -> DataFrame:
    """id, mark and text of at most most[m] labelled documents of each mark m, the first by a hash of the id.

    marks has id and mark, a row for each id. The texts of a mark have about ``most_bytes`` bytes at most: an eighth of that is the most of
    a single text, of which excerpt() takes more, and when they are used up the sample ends. So texts of every length are in it. Of several texts of
    one document that with the smallest hash is taken. Only ids and sizes reach the driver; the chosen ids go to all executors.
    """
    spark, text, each = docs.sparkSession, shared.whole_text(), max(1, most_bytes // 8)
    known = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("size"))
    known = known.join(marks, "id").groupBy("id", "mark").agg(F.min(F.struct("hash", "size")).alias("one"))
    rows = []
    for mark, n in most.items():
        room = most_bytes
        for r in known.where(F.col("mark") == mark).orderBy(F.xxhash64("id"), "id").limit(n).collect():
            size = min(r["one"]["size"], each)
            if size > room:
                break
            room -= size
            rows.append((r["id"], r["one"]["hash"], mark))
    kind = f"id {docs.schema['doc_id'].dataType.simpleString()}, hash long, mark int"
    some = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), excerpt(text, each).alias("text"))
    return some.join(F.broadcast(spark.createDataFrame(rows, kind)), ["id", "hash"]).groupBy("id", "mark").agg(F.first("text").alias("text"))
