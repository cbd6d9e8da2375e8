"""Selection by how well a text's character n-grams match a target's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Workspace, written
from .scalars import beside

SMOOTHING = 0.01


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All runs of n characters of the lower-cased text, overlapping: a lookahead at each character, which is then passed over whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


#: Grams that a task counts before it gives its counts away.
AT_ONCE = 1_000_000


def coded(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of n characters (3 at most) of the texts as numbers, 21 bits for a character, and the text that each is in. Numbers are ordered as the grams."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    m = max(0, len(code) - n + 1)
    grams = np.zeros(m, np.int64)
    for k in range(n):
        grams = (grams << 21) | code[k : k + m]
    inside = of[:m] == of[n - 1 : n - 1 + m]
    return grams[inside], of[:m][inside]


def distinct_grams(texts: list[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of n characters of the texts, and for all runs the number of theirs and the text that each is in."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    m = max(0, len(code) - n + 1)
    place = np.flatnonzero(of[:m] == of[n - 1 : n - 1 + m])
    number = np.zeros(len(place), np.int64)
    for lo in range(0, n, 3):  # three characters are a number of 63 bits; each further three make the runs so far more
        part = np.zeros(len(place), np.int64)
        for k in range(lo, min(lo + 3, n)):
            part = (part << 21) | code[place + k]
        rank = np.unique(part, return_inverse=True)[1]
        number = np.unique(number * (int(rank.max(initial=0)) + 1) + rank, return_inverse=True)[1]
    first = np.unique(number, return_index=True)[1]
    whole = code[place[first][:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + n] for i in range(0, len(whole), n)], number, of[place]


def lowered(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))


def gram_counts(df: DataFrame, text: str, n: int = 3) -> DataFrame:
    """gram and cnt (code and cnt of runs of up to three characters, which are counted as numbers). Tasks count before anything is shuffled."""
    if n > 3:
        return lowered(df, text).mapInArrow(_long_counts(n, AT_ONCE), "gram string, cnt long, missed long").where("gram is not null").groupBy("gram").agg(F.sum("cnt").alias("cnt"))

    def count(batches):
        held, size = [], 0

        def tally():
            grams, cnt = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            return grams, np.bincount(cnt, np.concatenate([c for _, c in held]), len(grams)).astype(np.int64)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                grams, cnt = np.unique(coded(batch.column(0).slice(lo, 256).to_pylist(), n)[0], return_counts=True)
                held.append((grams, cnt))
                size += len(grams)
                if size > 2 * AT_ONCE:
                    grams, cnt = tally()
                    if len(grams) > AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(cnt)], ["code", "cnt"])
                        grams, cnt = grams[:0], cnt[:0]
                    held, size = [(grams, cnt)], len(grams)
        if held:
            grams, cnt = tally()
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(cnt)], ["code", "cnt"])

    return lowered(df, text).mapInArrow(count, "code long, cnt long").groupBy("code").agg(F.sum("cnt").alias("cnt"))


def _long_counts(n: int, most: int, forget: bool = False, known: pa.Array | None = None):
    """Counts of runs of n characters, in a task. With forget, a task holds ``most`` counters: when there are more, the largest that must go is taken off
    all, and rows without a gram say how much was (missed). With known, only these runs are counted."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("gram", use_threads=False).aggregate([("cnt", "sum")]).rename_columns(["gram", "cnt"])

    def run(batches):
        held, size, missed = [], 0, 0

        def give(found: pa.Table):
            for b in found.select(["gram", "cnt"]).to_batches(max_chunksize=10_000):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(len(b), pa.int64())], ["gram", "cnt", "missed"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                grams, number, _ = distinct_grams(batch.column(0).slice(lo, 256).to_pylist(), n)
                part = pa.table({"gram": pa.array(grams, pa.string()), "cnt": np.bincount(number, minlength=len(grams)).astype(np.int64)})
                if known is not None:
                    part = part.filter(pc.is_in(part.column("gram"), value_set=known))
                held.append(part)
                size += len(part)
                if size <= 2 * most:
                    continue
                found = summed(held)
                if len(found) > most and forget:
                    cnt = found.column("cnt").to_numpy()
                    off = int(np.partition(cnt, len(cnt) - most - 1)[len(cnt) - most - 1])
                    missed += off
                    found = found.set_column(1, "cnt", pa.array(cnt - off)).filter(pa.array(cnt > off))
                elif len(found) > most:
                    yield from give(found)
                    found = found.slice(0, 0)
                held, size = [found], len(found)
        if held:
            yield from give(summed(held))
        if forget:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([missed])], ["gram", "cnt", "missed"])

    return run


class Alphabet:
    """Runs of n characters as numbers, whose order is that of the runs: a digit for each character of the table."""

    def __init__(self, points: np.ndarray, n: int) -> None:
        self.points, self.n, self.bits = np.sort(points), n, max(1, int(len(points)).bit_length())
        self.fits = n * self.bits <= 62

    def coded(self, texts: list[str]) -> np.ndarray:
        """All runs of the texts. A digit of 0 stands between two texts."""
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        rank = np.zeros(int(self.points[-1]) + 1 if len(self.points) else 1, np.int64)
        rank[self.points] = np.arange(1, len(self.points) + 1)
        digit = rank[points]
        length = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(length + 1)[:-1] - 1
        digit[ends] = 0
        m = max(0, len(digit) - self.n + 1)
        code, inside = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(self.n):
            code = (code << self.bits) | digit[k : k + m]
        for k in range(self.n):
            at = ends - k
            inside[at[(at >= 0) & (at < m)]] = False
        return code[inside]

    def spelled(self, codes: np.ndarray) -> list[str]:
        digits = np.stack([(codes >> self.bits * k) & ((1 << self.bits) - 1) for k in range(self.n - 1, -1, -1)], 1)
        whole = self.points[digits - 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[i : i + self.n] for i in range(0, len(whole), self.n)]


def characters(texts: DataFrame) -> np.ndarray:
    """The code points that the texts (t) have."""

    def run(batches):
        seen = np.zeros(0x110000, bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                seen[np.frombuffer("".join(batch.column(0).slice(lo, 256).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], ["point"])

    return texts.mapInArrow(run, "point long").distinct().toArrow().column("point").to_numpy().astype(np.int64)


def _coded_counts(alphabet: Alphabet, most: int, forget: bool = False, known: np.ndarray | None = None):
    """As _long_counts(), of runs as numbers: code, cnt and missed."""

    def run(batches):
        names, missed = ["code", "cnt", "missed"], 0
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def tally():
            nonlocal codes, counts, held, size
            new, cnt = np.unique(np.concatenate(held), return_counts=True) if held else (codes[:0], counts[:0])
            if known is not None:
                at = np.minimum(np.searchsorted(known, new), len(known) - 1)
                new, cnt = new[known[at] == new], cnt[known[at] == new]
            at = np.minimum(np.searchsorted(codes, new), max(0, len(codes) - 1))
            there = codes[at] == new if len(codes) else np.zeros(len(new), bool)
            counts[at[there]] += cnt[there]
            codes, counts = np.concatenate([codes, new[~there]]), np.concatenate([counts, cnt[~there]])
            order = np.argsort(codes, kind="stable")
            codes, counts, held, size = codes[order], counts[order], [], 0

        def give():
            for lo in range(0, len(codes), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(codes[part]), pa.array(counts[part]), pa.nulls(len(codes[part]), pa.int64())], names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held.append(alphabet.coded([x or "" for x in batch.column(0).slice(lo, 256).to_pylist()]))
                size += len(held[-1])
                if size <= 2 * AT_ONCE:
                    continue
                tally()
                if len(codes) > most and forget:
                    off = int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1])
                    missed += off
                    codes, counts = codes[counts > off], counts[counts > off] - off
                elif len(codes) > most:
                    yield from give()
                    codes, counts = codes[:0], counts[:0]
        tally()
        yield from give()
        if forget:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([missed], pa.int64())], names)

    return run


#: Counters of a task, and candidates that are sent to all tasks to be counted again.
COUNTERS, MOST_CANDIDATES = 200_000, 2_000_000


def most_frequent(df: DataFrame, text: str, most: int, n: int = 3, counters: int = COUNTERS) -> DataFrame:
    """gram and cnt of the most frequent runs of n characters, exact; ties by the gram.

    Longer runs are numbers where the characters that the texts have are few enough for 62 bits, as they nearly always are, else strings. Of them, of which most are rare, tasks keep counters for the frequent ones and the amount by which their counts may be too low, which adds up over tasks.
    What could be among the first by its count and that amount is counted again, exactly. Where the amount is so large that a run without any counter
    could be among them, all runs are counted.
    """
    if n <= 3:
        return top_grams(gram_counts(df, text, n), most, n)
    alphabet = Alphabet(characters(lowered(df, text)), n)
    key, kind = ("code", "long") if alphabet.fits else ("gram", "string")

    def counted(most: int, **how) -> DataFrame:
        count = _coded_counts(alphabet, most, **how) if alphabet.fits else _long_counts(n, most, **how)
        return lowered(df, text).mapInArrow(count, f"{key} {kind}, cnt long, missed long")

    def top(counts: DataFrame) -> DataFrame:
        return top_grams(counts, most, n, alphabet.spelled)

    with Workspace(df.sparkSession, "grams") as work:
        kept = work.written(counted(counters, forget=True), "kept")
        low = work.written(kept.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("cnt").alias("cnt")), "low")
        missed = kept.agg(F.sum("missed")).first()[0] or 0
        last = low.orderBy(F.desc("cnt")).limit(most).agg(F.min("cnt"), F.count(F.lit(1))).first()
        if missed == 0:
            return written(top(low), "top")
        if last[1] == most and missed < last[0]:
            near = low.where(F.col("cnt") + missed >= last[0]).select(key).limit(MOST_CANDIDATES + 1).toArrow().column(0).combine_chunks()
            if len(near) <= MOST_CANDIDATES:
                known = np.sort(near.to_numpy()) if alphabet.fits else near
                return written(top(counted(len(near) + 1, known=known).groupBy(key).agg(F.sum("cnt").alias("cnt"))), "top")
        return written(top(counted(AT_ONCE).groupBy(key).agg(F.sum("cnt").alias("cnt"))), "top")


def top_grams(counts: DataFrame, most: int, n: int = 3, spell: Callable[[np.ndarray], list[str]] | None = None) -> DataFrame:
    """gram and cnt of the most frequent; ties by the gram. ``spell`` makes runs of codes that are not 21 bits a character."""
    if "gram" in counts.columns:
        return counts.orderBy(F.desc("cnt"), "gram").limit(most)

    def spelled(batches):
        for b in batches:
            if spell:
                yield pa.RecordBatch.from_arrays([pa.array(spell(b.column(0).to_numpy()), pa.string()), b.column(1)], ["gram", "cnt"])
                continue
            grams = ["".join(chr((x >> 21 * k) & 0x1FFFFF) for k in range(n - 1, -1, -1)) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), b.column(1)], ["gram", "cnt"])

    return counts.orderBy(F.desc("cnt"), "code").limit(most).mapInArrow(spelled, "gram string, cnt long")


def log_ratios(source: DataFrame, target: DataFrame) -> DataFrame:
    """gram and log_ratio over the union of both vocabularies: smoothed by a hundredth of the source's total, floored at 1e-10."""
    both = source.select("gram", F.col("cnt").alias("s")).join(target.select("gram", F.col("cnt").alias("t")), "gram", "full_outer")
    both = both.fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("ts"), F.sum("t").alias("tt"), F.count(F.lit(1)).alias("v"))
    smooth = F.col("ts") * SMOOTHING
    p = lambda c, total: F.greatest((F.col(c) + smooth) / (F.col(total) + smooth * F.col("v")), F.lit(1e-10))
    return beside(both, totals).select("gram", F.ln(p("t", "tt") / p("s", "ts")).alias("log_ratio"))


def gram_weights(pool: DataFrame, target: DataFrame, id_col: str, text: str, n: int = 3, features: int = 10_000) -> DataFrame:
    """id and weight: the mean log-ratio of the text's grams that have one, 0 if none, scaled to 0..1 over the pool (all 0 if all are equal).

    The ratios, of which there are 2 * features at most, go to the tasks, and each text is read once for them; the means are written.
    """
    ratios = log_ratios(most_frequent(pool, text, features, n), most_frequent(target, text, features, n))
    raw = _raw_weights(pool, id_col, text, n, ratios.toPandas())
    raw = written(raw, "weights")
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return beside(raw, ends).select(id_col, "raw", scaled.alias("weight"))


def _raw_weights(pool: DataFrame, id_col: str, text: str, n: int, ratios: pd.DataFrame) -> DataFrame:
    """id and raw: the mean ratio of each text's runs that have one."""
    if n > 3:
        by_gram = dict(zip(ratios["gram"], ratios["log_ratio"].astype(float), strict=True))
    else:
        known = coded(ratios["gram"].tolist(), n)[0]
        order = np.argsort(known)
        known, ratio = known[order], ratios["log_ratio"].to_numpy(float)[order]

    def weigh(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                if n > 3:
                    grams, number, of = distinct_grams(part.column(1).to_pylist(), n)
                    each = np.array([by_gram.get(g, np.nan) for g in grams], float)[number]
                    there = ~np.isnan(each)
                    found = each[there]
                else:
                    grams, of = coded(part.column(1).to_pylist(), n)
                    at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
                    there = known[at] == grams if len(known) else np.zeros(len(grams), bool)
                    found = ratio[at[there]]
                sums = np.bincount(of[there], found, part.num_rows)
                raw = sums / np.maximum(np.bincount(of[there], minlength=part.num_rows), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw)], [id_col, "raw"])

    kind = pool.schema[id_col].dataType.simpleString()
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    return pool.select(id_col, lower.alias("__t")).mapInArrow(weigh, f"{id_col} {kind}, raw double")
