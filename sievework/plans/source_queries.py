"""Queries over tables as files: rows by position, archives of scores, Arrow files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archives, positions
from ..sources.tables import scratch, table
from .influence_queries import INFLUENCE, influences
from .registry import query

RANKED = "r AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)"


def in_files(df, key: str, files: int, path: str) -> str:
    """df written in so many files, in the order of a key."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(path)
    return path


@query("positional_join", f"WITH {RANKED} SELECT position, doc_id, lang, n_chars * 2 AS twice FROM r")
def positional_join(spark, sf_dir):
    """Two tables of as many rows, in different files, side by side."""
    docs = table(spark, sf_dir, "documents")
    left = positions.read_numbered(spark, in_files(docs.select("doc_id", "lang"), "doc_id", 7, scratch(spark, "left")))
    values = docs.select("doc_id", (F.col("n_chars") * 2).alias("twice"))
    right = positions.read_numbered(spark, in_files(values, "doc_id", 4, scratch(spark, "right"))).select("position", "twice")
    return positions.with_column_by_position(left, right, "twice").select("position", "doc_id", "lang", "twice")


@query("gather_in_order", f"WITH {RANKED}, w AS (SELECT position AS place, (position * 37 + 11) % n - CASE WHEN position % 2 = 0 THEN n ELSE 0 END AS wanted FROM r) SELECT place, doc_id, lang FROM w JOIN r ON r.position = w.wanted + CASE WHEN wanted < 0 THEN n ELSE 0 END")
def gather_in_order(spark, sf_dir):
    """The rows at a list of positions, every second counted from the end."""
    rows = positions.read_numbered(spark, in_files(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 7, scratch(spark, "pool")))
    n = rows.count()
    place = F.col("position")
    wanted = rows.select(place.alias("place"), ((place * 37 + 11) % n - F.when(place % 2 == 0, n).otherwise(0)).alias("position"))
    return positions.gathered(rows, wanted).select("place", "doc_id", "lang")


@query("head_by_position", f"WITH {RANKED} SELECT position, doc_id FROM r WHERE position >= n // 10 AND position < n // 5")
def head_by_position(spark, sf_dir):
    """The second tenth of the rows."""
    rows = positions.read_numbered(spark, in_files(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, scratch(spark, "pool")))
    n = rows.count()
    return positions.rows_between(rows, n // 10, n // 5).select("position", "doc_id")


@query("archive_round_trip", f"WITH {INFLUENCE} SELECT vec_id, dim, round(score, 6) AS score, CASE WHEN score > 0 THEN 'up' END AS label FROM vi WHERE dim IN ('chat', 'safety')")
def archive_round_trip(spark, sf_dir):
    """Validation influence in NumPy archives, two of whose dimensions are read again; the filter decides which archives are opened."""
    archives.register(spark)
    path = scratch(spark, "archive")
    rows = influences(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), F.lit(3).cast("long").alias("step"), "dim", "score", F.when(F.col("score") > 0, "up").alias("label"))
    rows.write.format("score_archive").mode("append").option("about", '{"of": "validation influence"}').save(path)
    found = spark.read.format("score_archive").load(path).where(F.col("dim").isin("chat", "safety") & (F.col("step") == 3))
    return found.select(F.col("sample_id").alias("vec_id"), "dim", F.round("score", 6).alias("score"), "label")


@query("arrow_scan", "SELECT doc_id, lang, length(text) AS chars FROM documents WHERE lang <> 'en'")
def arrow_scan(spark, sf_dir):
    """The documents as Arrow files, of which three columns are read."""
    archives.register(spark)
    path = scratch(spark, "arrow")
    table(spark, sf_dir, "documents").write.format("arrow_ipc").mode("append").save(path)
    return archives.arrow_scan(spark, path, ["doc_id", "lang", "text"]).where("lang <> 'en'").select("doc_id", "lang", F.char_length("text").cast("long").alias("chars"))
