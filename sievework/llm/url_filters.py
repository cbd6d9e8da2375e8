"""Exact lists of urls without joins: a cascade of Bloom filters over all keys of a corpus.

A list of keys is encoded against the complete universe of keys that the corpus asks for. The first filter has the listed keys; the
keys of the universe that it takes for listed by mistake go to the second filter, the listed ones which the second takes for
mistakes to the third, and so on, until a filter makes no mistake. A key that the first filter to turn it away is number i of is
listed if i is even; one that none turns away is listed if the number of filters is odd. That is exact for all keys of the universe.

Keys of a url are its rules' and its own. A rule is a host and the beginning of a path, and holds for subdomains; a url asks for the ends of
its host and the beginnings of its path that have as many labels and characters as a rule has. Of the listed rules the longest wins (of
those equally long the first in order of characters). A url without one is blocked if it is listed itself, else allowed. Allowing and blocking
rules have a cascade each.

The filters alone go to all executors. A list longer than ``most`` keys is dealt out by hash to several cascades, which are built and asked one
after the other, each over the keys of its own share; so what is sent is bounded by ``most``, and nothing is cut. Mistakes are found where
the keys are; bits are put together by aggregation, and no more of them reach the driver than the filter has.

Two keys are told apart by two 64-bit hashes.

Cases: a null url, and one without ``://``, has an empty host and path, and no rule but one that is empty itself; repeated rows each get
their verdict; an empty list blocks nothing; an empty table gives an empty result; columns may have any other names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, written
from .text import mixed

#: Keys of a list in one cascade: with a universe of 10^12 keys some 130 MB of filters.
MOST_KEYS = 20_000_000
PAIR = "high long, low long"


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("low"))


@dataclass(frozen=True)
class Filter:
    """A Bloom filter: ``k`` bits of ``words`` for each key."""

    words: np.ndarray
    k: int
    salt: int

    @staticmethod
    def bits(high: np.ndarray, low: np.ndarray, size: int, k: int, salt: int) -> np.ndarray:
        """The numbers of the bits of each key, k rows."""
        with np.errstate(over="ignore"):
            begin = mixed(high.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            step = mixed(low.view(np.uint64) ^ np.uint64(salt)) | np.uint64(1)
            return np.stack([mixed(begin + np.uint64(i) * step) % np.uint64(size) for i in range(k)]).astype(np.int64)

    def has(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = self.bits(high, low, 64 * len(self.words), self.k, self.salt)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)


class Cascade:
    """Filters in turn."""

    def __init__(self, filters: list[Filter]) -> None:
        self.filters = filters

    def has(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which keys are listed; exact for the universe that the cascade was made over."""
        out, todo = np.full(len(high), len(self.filters) % 2 == 1), np.arange(len(high))
        for i, f in enumerate(self.filters):
            passes = f.has(high[todo], low[todo])
            out[todo[~passes]] = i % 2 == 1
            todo = todo[passes]
        return out

    @property
    def n_bits(self) -> int:
        return sum(64 * len(f.words) for f in self.filters)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def encoded(keys: DataFrame, n: int, rate: float, salt: int) -> Filter:
    """The filter of n keys that has others by mistake at the given rate."""
    k = max(1, round(-log2(rate)))
    size = 64 * max(1, ceil(n * k / log(2) / 64))

    def run(batches):
        for b in batches:
            at = np.unique(Filter.bits(numbers(b.column(0)), numbers(b.column(1)), size, k, salt))
            begin = np.flatnonzero(np.diff(at >> 6, prepend=-1))
            words = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begin) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at[begin] >> 6), pa.array(words.view(np.int64))], ["word", "bits"])

    found = keys.select("high", "low").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[numbers(found.column("word").combine_chunks())] = numbers(found.column("bits").combine_chunks()).view(np.uint64)
    return Filter(words, k, salt)


def passing(keys: DataFrame, f: Filter) -> DataFrame:
    """The keys that a filter has, rightly or not."""
    sent = keys.sparkSession.sparkContext.broadcast(f)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.has(numbers(b.column(0)), numbers(b.column(1)))))

    return keys.select("high", "low").mapInArrow(run, PAIR)


def build(listed: DataFrame, others: DataFrame, work: Workspace) -> Cascade:
    """The cascade of listed keys against all others; both have distinct high and low, and are written tables."""
    inside, outside = listed.count(), others.count()
    filters: list[Filter] = []
    # a first filter with about as many mistakes as there are listed keys, then halves
    rate = min(0.5, max(2.0**-30, inside / (2**0.5 * max(1, outside))))
    while inside:
        f = encoded(listed, inside, rate, len(filters))
        filters.append(f)
        wrong = work.written(passing(others, f), "mistakes")
        listed, others, inside, outside, rate = wrong, listed, wrong.count(), inside, 0.5
        if len(filters) > 200:
            raise ValueError("two keys have the same hashes")
    return Cascade(filters)


def marked(rows: DataFrame, cascade: Cascade, share: int, shares: int, into: str) -> DataFrame:
    """rows with the column ``into``, which says of each of the row's keys (arrays high and low) whether it is listed; other shares' keys stay as they are."""
    sent = rows.sparkSession.sparkContext.broadcast(cascade)
    names, at = rows.columns, rows.columns.index(into)

    def run(batches):
        for b in batches:
            high, low, known = (b.column(names.index(x)) for x in ("high", "low", into))
            h, w, k = numbers(high.flatten()), numbers(low.flatten()), known.flatten().to_numpy(zero_copy_only=False).astype(bool)
            mine = np.flatnonzero(h % shares == share)
            k[mine] = sent.value.has(h[mine], w[mine])
            offsets = np.concatenate([[0], np.cumsum(high.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            columns = list(b.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(k))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def members(rows: DataFrame, lists: dict[str, DataFrame], work: Workspace, most: int = MOST_KEYS) -> DataFrame:
    """rows (with arrays high and low, the keys' hashes) with a column of booleans for each list, which says which keys are listed.

    lists: name -> high and low. The universe is all keys of rows.
    """
    universe = work.written(rows.select(F.explode(F.arrays_zip("high", "low")).alias("x")).select("x.*").distinct(), "universe")
    for name, keys in lists.items():
        # keys that the corpus never asks for need no place
        listed = work.written(keys.select("high", "low").distinct().join(universe, ["high", "low"], "left_semi"), "listed")
        others = universe.join(listed, ["high", "low"], "left_anti")
        shares = max(1, ceil(listed.count() / most))
        rows = rows.withColumn(name, F.transform("high", lambda _: F.lit(False)))
        for share in range(shares):
            of = F.pmod("high", F.lit(shares)) == share
            cascade = build(listed.where(of), work.written(others.where(of), "others"), work)
            rows = marked(rows, cascade, share, shares, name)
            if shares > 1:
                rows = work.written(rows, "marked")
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rule and verdict, from (rule, verdict): a rule is a host, and all from its first slash on the beginning of a path."""
    return spark.createDataFrame(rules, "rule string, verdict string")


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """How many labels and how many characters of the path rules have: as many pairs as there are different ones."""
    host = F.substring_index("rule", "/", 1)
    found = rules.select(F.size(F.split(host, r"\.")).alias("labels"), (F.char_length("rule") - F.char_length(host)).alias("length")).distinct()
    return sorted((r["labels"], r["length"]) for r in found.collect())


def judged(pages: DataFrame, rules: DataFrame, blocked: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; rules: rule and verdict (allow or block); blocked: url, blocked where no rule fits."""
    with Workspace(pages.sparkSession, "urls") as work:
        host, path = host_and_path(F.col("url"))
        rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
        labels = F.split("host", r"\.")
        some = [
            F.when((F.size(labels) >= n) & (F.char_length("path") >= size), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, size)))
            for n, size in shapes(rules)
        ]
        fitting = F.filter(F.array(*some), lambda x: x.isNotNull()) if some else F.array().cast("array<string>")
        # "r" before a rule's key and "u" before a url's
        keys = F.concat(F.array(F.concat(F.lit("u"), "url")), F.transform(fitting, lambda x: F.concat(F.lit("r"), x)))
        rows = rows.select("page_id", "host", "path", keys.alias("keys"))
        high, low = F.transform("keys", lambda x: hashes(x)[0]), F.transform("keys", lambda x: hashes(x)[1])
        rows = work.written(rows.withColumns({"high": high, "low": low}), "keys")
        of_rules = rules.select(F.concat(F.lit("r"), "rule").alias("key"), "verdict")
        of_urls = blocked.select(F.concat(F.lit("u"), F.coalesce("url", F.lit(""))).alias("key"))
        lists = {
            "allow": of_rules.where("verdict = 'allow'").select("key"),
            "block": of_rules.where("verdict = 'block'").select("key").union(of_urls),
        }
        lists = {name: x.select(*[h.alias(n) for h, n in zip(hashes(F.col("key")), ("high", "low"), strict=True)]) for name, x in lists.items()}
        rows = members(rows, lists, work, most)
        each = F.filter(F.arrays_zip("keys", "allow", "block"), lambda x: x["keys"].startswith("r") & (x["allow"] | x["block"]))
        # the longest, and of those equally long the first
        best = F.array_min(F.transform(each, lambda x: F.struct((-F.char_length(x["keys"])).alias("length"), x["keys"].alias("key"), x["allow"].alias("allow"))))
        rows = rows.select("page_id", "host", "path", F.element_at("block", 1).alias("listed"), best.alias("best"))
        verdict = F.when(F.col("best").isNotNull(), F.when(F.col("best.allow"), "allow").otherwise("block")).otherwise(F.when(F.col("listed"), "block").otherwise("allow"))
        return written(rows.select("page_id", "host", "path", F.substr("best.key", F.lit(2)).alias("rule"), verdict.alias("verdict")), "verdicts")


def only_copies(pages: DataFrame) -> DataFrame:
    """url of the pages that only repeat others: each page of that url has the html (null: empty) of one with a smaller page_id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = keyed.where(F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("page_id")).select("page_id", F.lit(True).alias("first"))
    flagged = keyed.select("page_id", "url").join(first, "page_id", "left")
    return flagged.groupBy("url").agg(F.max(F.coalesce("first", F.lit(False)) | F.col("page_id").isNull()).alias("own")).where(~F.col("own")).select("url")
