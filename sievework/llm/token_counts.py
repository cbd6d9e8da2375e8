"""Token counts through a cache of digests.

A text's key is the digest of its normalised content under the digest of the tokenizer (its file and the
normalisation). Texts whose key the cache has get the stored count; each distinct other text is encoded once, and its
count appended to the cache.

The normalised content has each run of ASCII white space as one space, and none at the ends, where the tokenizer drops
white space anyway; for others it is the text itself. Digests are made where the texts are, once for the rows and once for the distinct
texts, which alone are shuffled. Counts of texts that many rows have are sent to all executors, so that no task gets all those rows.

Cases: a null text counts as the empty one; repeated rows each get their count; the cache may hold a key twice (from
jobs at the same time); an empty table gives an empty result and leaves the cache as it is; columns may have any other
names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .tokens import by_words, encoder

CACHE = "version string, digest binary, n_tokens long"


def version(path: str) -> str:
    """The digest of the tokenizer's file and of how content is normalised for it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + (b"spaces" if by_words(path) else b"exact")).hexdigest()


def digest(text: Column, spaces: bool) -> Column:
    content = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")) if spaces else text
    return F.unhex(F.sha2(content.cast("binary"), 256))


def stored(spark, cache: str, of: str) -> DataFrame:
    """digest and n_tokens of what the cache has for a tokenizer."""
    there = spark.read.schema(CACHE).parquet(cache) if shared.exists(spark, cache) else spark.createDataFrame([], CACHE)
    return there.where(F.col("version") == of).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, path: str) -> None:
    """Encodes each distinct text that the cache lacks, and appends the counts."""
    of, spaces = version(path), bool(by_words(path))

    def count(batches):
        enc = encoder(path)
        for batch in batches:
            n = [0]
            for _, at in enc.ids(batch.column(1)):
                n.extend((at[1:] - at[:-1]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n[1:], pa.int64())], ["digest", "n_tokens"])

    text = shared.whole_text()
    distinct = docs.select(digest(text, spaces).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored(docs.sparkSession, cache, of), "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long").select(
        F.lit(of).alias("version"), "digest", "n_tokens"
    ).write.mode("append").parquet(cache)


def counted(docs: DataFrame, cache: str, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document; cache is a Parquet folder, made where it is not there."""
    fill(docs, cache, path)
    text = shared.whole_text()
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest(text, bool(by_words(path))).alias("digest"))
    found = shared.looked_up(shared.written(keyed, "digests"), stored(docs.sparkSession, cache, version(path)), "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
