"""Resharding by a minimum-cost flow.

Shards are folders of Parquet files. From the bytes in each old shard and the capacity of each new one, a flow says how many bytes go
from where to where so that the fewest move. The files of an old shard lie on a line, in the order of their names; the flow cuts this line
into runs, what stays first. A file that lies wholly in what stays is left as it is. The other files are rewritten: one that lies in a
single run goes there whole, and in the few that a cut goes through, a document goes where the middle of its bytes lies, so that shards
are as the flow asks to within a document.

Only totals for each shard reach the driver, and the names of the files that stay. Places in a shard are those of a row in its file, plus
the rows of the files before it, so no task sees a shard.

Cases: a null text has no bytes, and stays null; rows may repeat, and are dealt to files by where they stand, whatever they hold; a null
doc_id is a key as any other; documents of equal size stay in their order; with no documents there are no files, and an empty result; other
columns are kept, whatever their names; a column ``shard`` gives way to the new one.
"""

from __future__ import annotations

import functools
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared

#: A shard has so many files, if its documents are enough, so that some can stay.
LEAST_FILES = 8


def size_of(text: str = "text") -> Column:
    """A document's size: its text's UTF-8 bytes plus 8."""
    return (F.octet_length(shared.whole_text(text)) + F.lit(8)).cast("long")


def cheapest_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old shard i to each new shard j at the least sum of bytes times cost(i, j).

    Successive shortest paths; the graph has an edge for each pair of shards.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = {}
    price: dict[tuple[int, int], int] = {}
    near: list[set[int]] = [set() for _ in range(n + m + 2)]

    def edge(a: int, b: int, most: int, each: int) -> None:
        room[a, b], room[b, a], price[a, b], price[b, a] = most, 0, each, -each
        near[a].add(b)
        near[b].add(a)

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
        for j in range(m):
            edge(i, n + j, sum(supply), cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    while True:
        far, came, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b in sorted(near[a]):
                if room[a, b] and (b not in far or far[a] + price[a, b] < far[b]):
                    far[b], came[b] = far[a] + price[a, b], a
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if sink not in far:
            return {(i, j): room[n + j, i] for i in range(n) for j in range(m) if room[n + j, i]}
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        least = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= least
            room[b, a] += least


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def write(docs: DataFrame, shard: Column, n: int, path: str, text: str = "text", most: int = 64 << 20, least: int = 1 << 20) -> StructType:
    """Writes docs as shards 0 to n - 1: a folder for each, with files of about ``most`` bytes of documents; smaller ones, but of ``least``
    bytes or more, where a shard would have fewer than LEAST_FILES. Returns the schema, with the column shard."""
    total = docs.agg(F.sum(size_of(text))).first()[0] or 0
    each = max(min(LEAST_FILES, total // (n * least)), -(-total // (n * most)), 1)
    kept = [c for c, name in zip(shared.own_columns(docs), docs.columns, strict=True) if name.lower() != "shard"]
    (salt,) = shared.unused([*docs.columns, "shard"], "salt")
    # by where a row stands, so that rows of one key or text do not meet in one file
    dealt = docs.select(*kept, shard.cast("int").alias("shard")).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(each)))
    found = dealt.repartition(n * each, "shard", salt).drop(salt)
    found.write.partitionBy("shard").parquet(path)
    return found.schema


def with_places(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with the path of each row's file and its place there; and the names of the two columns."""
    path, place = shared.unused(df.columns, "path", "place")
    return df.withColumns({path: F.col("_metadata.file_path"), place: F.col("_metadata.row_index")}), path, place


def laid(rows: DataFrame, path: str, amount: Column) -> DataFrame:
    """path, shard, size and begin of each file: where it begins on its shard's line. The sums run over files, not rows."""
    files = rows.groupBy(F.col(path).alias("path"), "shard").agg(F.sum(amount).alias("size"))
    before = Window.partitionBy("shard").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))


@dataclass(frozen=True)
class Resharded:
    """Where the new shards are: the files of the old ones that are as they were, and a folder of new files. And what was done, in bytes of documents."""

    base: str
    kept: list[str]
    new: str
    schema: StructType
    total: int
    moved: int
    rewritten: int

    def parts(self, spark: SparkSession) -> list[DataFrame]:
        """The documents in old files, if any, and in new ones, with the column shard; a frame each, as _metadata is that of one scan."""
        new = spark.read.schema(self.schema).parquet(self.new)
        return [spark.read.schema(self.schema).option("basePath", self.base).parquet(*self.kept), new] if self.kept else [new]

    def read(self, spark: SparkSession) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self.parts(spark))


def reshard(spark: SparkSession, schema: StructType, path: str, n_old: int, n_new: int, out: str, text: str = "text") -> Resharded:
    """Makes n_new shards of equal bytes from the n_old ones that write() has put into ``path``, which stays; new files go to ``out``."""
    docs = spark.read.schema(schema).parquet(path)
    rows, file, place = with_places(docs)
    with shared.Workspace(spark, "resharding") as work:
        files = work.written(laid(rows, file, size_of(text)), "files")
        held = dict(files.groupBy("shard").agg(F.sum("size")).collect())  # a row for each old shard
        supply = [held.get(i, 0) for i in range(n_old)]
        flow = cheapest_flow(supply, even(sum(supply), n_new), lambda i, j: int(i != j))
        runs, at = [], [0] * n_old
        for i, j in sorted(flow, key=lambda x: (x[0], x[0] != x[1], x[1])):
            runs.append((i, at[i], at[i] + flow[i, j], j))
            at[i] += flow[i, j]

        def goes_to(old: Column, point: Column) -> Column:
            """The new shard of a point on an old shard's line."""
            to = F.lit(None).cast("int")
            for i in range(n_old):
                mine = [r for r in runs if r[0] == i]
                if mine:
                    choice = F.lit(mine[-1][3])
                    for _, _, stop, j in reversed(mine[:-1]):
                        choice = F.when(point < stop, F.lit(j)).otherwise(choice)
                    to = F.when(old == i, choice).otherwise(to)
            return to

        first, last = (goes_to(F.col("shard"), x) for x in (F.col("begin"), F.col("begin") + F.col("size") - 1))
        marked = work.written(files.withColumns({"first": first, "last": last}), "marked")
        stays = (F.col("first") == F.col("shard")) & (F.col("last") == F.col("shard"))
        kept = [r["path"] for r in marked.where(stays).select("path").collect()]  # names of files
        mine, begin, one, size, reach = shared.unused(rows.columns, "mine", "begin", "one", "size", "reach")
        target = F.when(F.col("first") == F.col("last"), F.col("first"))
        plan = marked.where(~stays).select(F.col("path").alias(mine), F.col("begin").alias(begin), target.alias(one))
        changed = rows.join(shared.sent_if_small(plan), F.col(file) == F.col(mine))
        keep = [c for c, name in zip(shared.own_columns(docs), docs.columns, strict=True) if name != "shard"]
        whole = changed.where(F.col(one).isNotNull()).select(*keep, F.col(one).alias("shard"))
        line = Window.partitionBy(file).orderBy(place)
        cut = changed.where(F.col(one).isNull()).withColumn(size, size_of(text)).withColumn(reach, F.col(begin) + F.sum(size).over(line))
        cut = cut.select(*keep, goes_to(F.col("shard"), F.col(reach) - F.col(size) / 2).alias("shard"))
        whole.unionByName(cut).write.partitionBy("shard").parquet(out)
        rewritten = marked.where(~stays).agg(F.sum("size")).first()[0] or 0
    return Resharded(path, kept, out, docs.schema, sum(supply), sum(v for (i, j), v in flow.items() if i != j), rewritten)


def digests(docs: DataFrame, out: str, n_old: int = 16, n_new: int = 24) -> DataFrame:
    """Writes n_old shards by a hash of doc_id, makes n_new of them, and reads each document's size, checksum and place from the files."""
    spark = docs.sparkSession
    schema = write(docs.select("doc_id", "text"), F.pmod(F.xxhash64("doc_id"), F.lit(n_old)), n_old, f"{out}/old")
    parts = []
    for part in reshard(spark, schema, f"{out}/old", n_old, n_new, f"{out}/new").parts(spark):
        rows, file, place = with_places(part)
        text = shared.whole_text()
        parts.append(rows.select("doc_id", size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", F.col(file).alias("file"), F.col(place).alias("place")))
    found = shared.written(functools.reduce(DataFrame.unionByName, parts), "digests")
    begins = laid(found, "file", F.lit(1)).select(F.col("path").alias("file"), "begin")
    return found.join(shared.sent_if_small(shared.written(begins, "begins")), "file").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("begin") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
