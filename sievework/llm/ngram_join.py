"""Self-join of documents by the Jaccard similarity of their word n-grams, as a T-occurrence search.

Two documents of a and b shingles link at p per cent where they share T = p (a + b) / (100 + p) of them or more. DivideSkip
splits a document's inverted lists: the L longest are only probed, and as L is T - 1 at most, one of the short lists must
have the partner. Distributed:

1. Documents with equal sets are one class. Shingles are ordered by how many documents have them (from the shingles that
   are frequent somewhere), rare first, so that the short lists come first.
2. Each class is dealt out to the lists of its first n - T + m shingles: two that link share m of these. A list that would be
   longer than SUBLIST is dealt out to sublists by a hash, so that no task holds a list. Lists with one class only are
   dropped, and classes that are left in fewer lists than m.
3. In each list a few classes, the same ones for lists of the same documents, are paired with all others. Pairs are checked by
   DivideSkip over an index of the candidates' sets: the short lists of the class that asks are merged by a heap, and candidates
   that occur often enough are looked up in its long lists by binary search. Links give components.
4. What is left are the classes of a list that are still apart. Each is held against the larger components that its lists
   have, each of which is an index, in blocks of bounded size, that is asked in the same way until one link is found. So
   copies by the thousand cost a few pairs each, and no link between components is lost.

For a list in sublists, what 3 and 4 must know of the whole list (its few classes, and its components with the ends of their
sizes) is aggregated beforehand and given to each sublist.

The order of shingles, which need not be exact, decides the cost only; all counts that decide a link are over whole sets.
Shingles and classes are 64-bit hashes.

Cases: a null text, or one without words, has no shingles, is linked with nothing and is its own component; with fewer
words than n the whole text is one shingle; equal documents are always together; rows may repeat; a null doc_id is larger than
all others, and a component of such documents alone has a null id; an empty table gives an empty result; columns may have any
other names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .text import Texts, mixed, multipliers, texts

#: Shingles counted at once, how often one must be there to count as frequent, and how many frequent ones are told to all.
AT_ONCE, OFTEN, MOST_FREQUENT = 500_000, 3, 200_000
#: Classes in a list, as far as they are counted, beyond which it is dealt out to sublists of about as many; rows of lists handled at once.
SUBLIST, ROWS = 20_000, 100_000
#: Ids up to which a list of them goes to every executor; longer ones are joined by a shuffle.
MOST_SENT = 1_000_000
#: Shingles of the candidates that one class is checked against at once.
AT_A_TIME = 150_000
#: How many classes of a list are held against the others, turn by turn, before the rest is settled.
CENTERS = (2, 16)


def shingles(t: Texts, n: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    words = t.word_hashes()
    windows, full = t.windows(words, n)
    first = t.first.tolist()
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mixed((words[a:b] * multipliers(0, b - a)).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(windows[:0])
    return out


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any that it links with."""
    return -(-percent * n // 100)


def shared_first(n, percent: int):
    """m: how many of its first n - needed + m shingles a set of n shares with any that it links with. One would do; a few more
    tell what is alike from what shares a passage, or a shingle by chance. A larger set has no smaller m."""
    return np.minimum(4 + n // 64, -(-percent * n // 100))


def shared_with_any(n, percent: int):
    """The least m of a set of n and a set that it links with, which has needed(n) shingles or more."""
    return shared_first(-(-percent * n // 100), percent)


def overlap(a, b, percent: int):
    """The least overlap of sets of a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def keyed(docs: DataFrame) -> DataFrame:
    """key (doc_id, or of a null one the hash of the text), doc_id, text and its hash."""
    return docs.select(*[x.alias(name) for name, x in identity().items()], shared.whole_text().alias("text"))


def identity() -> dict:
    doc_id, hash_ = F.col("doc_id").cast("long"), F.xxhash64(shared.whole_text())
    return {"key": F.coalesce(doc_id, hash_), "doc_id": doc_id, "hash": hash_}


class Frequent:
    """The shingles that a task has most often. Counts are exact as long as no more than MOST_FREQUENT are there twice."""

    def __init__(self) -> None:
        self.held, self.size = [], 0
        self.tokens, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.size += len(s)
        if self.size > AT_ONCE:
            self.tally()

    def tally(self) -> None:
        new, count = np.unique(np.concatenate(self.held), return_counts=True) if self.held else (self.tokens[:0], self.count[:0])
        known = np.isin(new, self.tokens, assume_unique=True)
        self.count[np.searchsorted(self.tokens, new[known])] += count[known]
        fresh = ~known & (count > 1)
        tokens, count = np.concatenate([self.tokens, new[fresh]]), np.concatenate([self.count, count[fresh]])
        if len(tokens) > MOST_FREQUENT:
            most = np.argpartition(count, -MOST_FREQUENT)[-MOST_FREQUENT:]
            tokens, count = tokens[most], count[most]
        order = np.argsort(tokens)
        self.tokens, self.count, self.held, self.size = tokens[order], count[order], [], 0


def described(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document: key, doc_id, hash, n and c (its class; null for the empty set). And rows token, often."""

    def run(batches):
        frequent, known = Frequent(), set()
        names = ["key", "doc_id", "hash", "n", "c", "token", "often"]
        for batch in batches:
            sets = []
            for t in texts(batch.column(3), lower=True):
                for s in shingles(t, n):
                    c = class_of(s) if len(s) else None
                    sets.append((len(s), c))
                    if c not in known and c is not None:
                        known.add(c)
                        frequent.add(s)
                if len(known) > 200_000:
                    known.clear()
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x for x, _ in sets], pa.int64()), pa.array([c for _, c in sets], pa.int64()), none, none], names
            )
        frequent.tally()
        often = frequent.count >= OFTEN
        none = pa.nulls(int(often.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(frequent.tokens[often].view(np.int64)), pa.array(frequent.count[often])], names)

    return keyed(docs).mapInArrow(run, "key long, doc_id long, hash long, n long, c long, token long, often long")


POSTING = ("token", "salt", "of", "c", "n", "place")


def postings(docs: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """POSTING for the first shingles of each class, the rarest first: token, the number of its sublist and how many it has, c, n and place."""
    sent, most = docs.sparkSession.sparkContext.broadcast(frequent), SUBLIST

    def run(batches):
        tokens, often = sent.value
        known = set()
        for batch in batches:
            for t in texts(batch.column(3), lower=True):
                found, times, classes, sizes = [], [], [], []
                for s in shingles(t, n):
                    c = class_of(s) if len(s) else None
                    if c is None or c in known:
                        continue
                    known.add(c)
                    first = len(s) - needed(len(s), percent) + int(shared_first(len(s), percent))
                    count = np.zeros(len(s), np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        count = np.where(tokens[at] == s, often[at], 0)
                        order = np.argsort(count, kind="stable")
                        s, count = s[order], count[order]
                    found.append(s[:first])
                    times.append(count[:first])
                    classes.append(c)
                    sizes.append(len(s))
                if len(known) > 200_000:
                    known.clear()
                if not found:
                    continue
                length = [len(x) for x in found]
                token, c, of = np.concatenate(found), np.repeat(np.array(classes, np.int64), length), np.concatenate(times) // most + 1
                salt = np.zeros(len(token), np.int64)
                many = of > 1
                if many.any():
                    with np.errstate(over="ignore"):
                        salt[many] = (mixed(token[many] + mixed(c[many].astype(np.uint64))) % of[many].astype(np.uint64)).astype(np.int64)
                place = np.concatenate([np.arange(k, dtype=np.int32) for k in length])
                columns = [token.view(np.int64), salt.astype(np.int32), of.astype(np.int32), c, np.repeat(np.array(sizes, np.int32), length), place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], list(POSTING))

    return keyed(docs).mapInArrow(run, "token long, salt int, of int, c long, n int, place int")


def in_lists(df: DataFrame) -> DataFrame:
    """In the order that lists() wants."""
    return df.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "c")


def lists(batches, columns: tuple[str, ...], rows: int = ROWS) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Whole sublists of the rows of in_lists(), each class once, about so many rows at a time: the columns, and where each begins and ends."""

    def arranged(parts):
        x = dict(zip(columns, (np.concatenate(p) for p in zip(*parts, strict=True)), strict=True))
        changes = (x["token"][1:] != x["token"][:-1]) | (x["salt"][1:] != x["salt"][:-1])
        first = np.ones(len(x["c"]), bool)
        first[1:] = changes | (x["c"][1:] != x["c"][:-1])
        begins = np.concatenate([[True], changes])[first]
        begin = np.flatnonzero(begins)
        return {k: v[first] for k, v in x.items()}, begin, np.append(begin[1:], len(begins))

    held, size = [], 0
    for batch in batches:
        new = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        if not len(new[0]):
            continue
        token, salt = new[columns.index("token")], new[columns.index("salt")]
        if size >= rows:
            # up to where the batch's first list ends, if it does
            before = held[-1][columns.index("token")][-1], held[-1][columns.index("salt")][-1]
            other = (token != before[0]) | (salt != before[1])
            at = int(other.argmax())
            if other[at]:
                yield arranged([*held, [v[:at] for v in new]])
                held, size, new = [], 0, [v[at:] for v in new]
        held.append(new)
        size += len(new[0])
    if size:
        yield arranged(held)


def shared_lists(found: DataFrame) -> DataFrame:
    """The postings of lists that have two classes or more, and of all sublists."""

    def run(batches):
        for x, begin, end in lists(batches, POSTING):
            stays = (end - begin > 1) | (x["of"][begin] > 1)
            at = np.repeat(stays, end - begin)
            yield pa.RecordBatch.from_arrays([pa.array(x[k][at]) for k in x], list(x))

    return in_lists(found).mapInArrow(run, found.schema)


def up(x: Column, k: int) -> Column:
    """x / k, rounded up."""
    return F.ceil(x / F.lit(k))


def shared_first_sql(n: Column, percent: int) -> Column:
    return F.least(F.lit(4) + F.floor(n / 64), up(n * percent, 100))


def shared_with_any_sql(n: Column, percent: int) -> Column:
    return shared_first_sql(up(n * percent, 100), percent)


def in_enough_lists(live: DataFrame, percent: int) -> DataFrame:
    """c of the classes that are in as many lists as a link needs."""
    times = live.groupBy("c").agg(F.count(F.lit(1)).alias("times"), F.max("n").cast("long").alias("n"))
    return times.where(F.col("times") >= shared_with_any_sql(F.col("n"), percent)).select("c")


def may_link(x: dict[str, np.ndarray], i: int, js: np.ndarray, percent: int) -> np.ndarray:
    """Which classes js can link with class i, where this list's shingle is one of the first m that they share: by size, and by
    what can follow in both."""
    a, b = int(x["n"][i]), x["n"][js].astype(np.int64)
    left = np.minimum(a - int(x["place"][i]), b - x["place"][js])
    before = np.minimum(shared_first(a, percent), shared_first(b, percent)) - 1
    return (percent * np.maximum(a, b) <= 100 * np.minimum(a, b)) & (left + before >= overlap(a, b, percent))


def may_link_sql(a: Column, b: Column, left: Column, percent: int) -> Column:
    before = F.least(shared_first_sql(a, percent), shared_first_sql(b, percent)) - 1
    return (percent * F.greatest(a, b) <= 100 * F.least(a, b)) & (left + before >= up(percent * (a + b), 100 + percent))


def to_sublists(of_list: DataFrame) -> DataFrame:
    """A row of each list (token, of, ...) for each of its sublists."""
    return of_list.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")


def stars(live: DataFrame, percent: int, centers: int, turn: int, hot: bool) -> DataFrame:
    """Pairs a, b, nb: of each list, in runs of like size, some classes a that stand early in their sets, each with all others.

    Hashes pick the classes, so that lists of the same documents have the same ones, and others in another turn. live has the
    columns root and size of the component: the classes are of the largest component there, the others not, unless all are single.
    """

    def run(batches):
        for x, begin, end in lists(batches, (*POSTING, "root", "size")):
            of, to = [], []
            n = x["n"].astype(np.int64)
            early = x["place"] < n - overlap(n, n, percent) + shared_first(n, percent)
            with np.errstate(over="ignore"):
                pick = mixed(x["c"].astype(np.uint64) + np.uint64(turn))
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                while lo < hi - 1:
                    stop = lo + int(np.searchsorted(x["n"][lo:hi], 100 * int(x["n"][lo]) // percent, "right"))
                    members = np.arange(lo, min(hi, max(stop, lo + 1)))
                    lo = max(stop, lo + 1)
                    top = members[np.lexsort((x["root"][members], x["size"][members]))[-1]]
                    some = members[early[members]]
                    if turn and x["size"][top] == 1:
                        continue  # all were held against some; the rest is settled at the end
                    if x["size"][top] > 1:
                        some, members = some[x["root"][some] == x["root"][top]], members[x["root"][members] != x["root"][top]]
                    for i in some[np.argsort(pick[some])[:centers]].tolist():
                        members = members[members != i]
                        js = members[may_link(x, i, members, percent)]
                        of.append(np.full(len(js), i))
                        to.append(js)
            i, j = (np.concatenate(v) if v else np.zeros(0, int) for v in (of, to))
            both = pd.DataFrame({"a": x["c"][i], "b": x["c"][j], "nb": x["n"][j], "need": np.minimum(2, shared_with_any(x["n"][i].astype(np.int64), percent))})
            both["times"] = 1
            both = both.groupby(["a", "b"], as_index=False, sort=False).agg({"nb": "min", "need": "min", "times": "sum"})
            yield pa.RecordBatch.from_pandas(both, preserve_index=False)

    found = in_lists(live.where("of = 1") if hot else live).mapInArrow(run, "a long, b long, nb int, need long, times long")
    if hot:
        found = found.unionByName(stars_of_sublists(live.where("of > 1"), percent, centers, turn))
    found = found.groupBy("a", "b").agg(F.min("nb").alias("nb"), F.min("need").alias("need"), F.sum("times").alias("times")).where("times >= need")
    return found.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"]).drop("need", "times")


def stars_of_sublists(live: DataFrame, percent: int, centers: int, turn: int) -> DataFrame:
    """The same for lists in sublists: the classes a are those of the whole list, by bands of like size, and each sublist's others meet them."""
    n = F.col("n").cast("long")
    band = n if percent >= 100 else F.floor(F.ln(n) / F.ln(F.lit(100 / percent)))
    banded = live.withColumn("band", band)
    early = F.col("place") < n - up(n * 2 * percent, 100 + percent) + shared_first_sql(n, percent)
    some = banded.where(early)
    if turn:
        top = banded.where("size > 1").groupBy("token", "band").agg(F.max(F.struct("size", "root")).alias("top"))
        some = some.join(top.select("token", "band", F.col("top.root").alias("root")), ["token", "band", "root"], "left_semi")
    each = [F.min(F.struct(F.xxhash64("c", F.lit(turn), F.lit(k)).alias("pick"), F.col("c").alias("a"), n.alias("na"), F.col("place").alias("at"), F.col("root").alias("of_root"))) for k in range(centers)]
    chosen = some.groupBy("token", "of", "band").agg(F.array_distinct(F.array(*each)).alias("some"))
    chosen = to_sublists(chosen.select("token", "of", "band", F.explode("some").alias("x")).select("token", "of", "band", "x.*").drop("pick").distinct())
    met = banded.join(chosen, ["token", "salt", "band"]).where("c <> a" + " and root <> of_root" * (turn > 0))
    met = met.where(may_link_sql(F.col("na"), n, F.least(F.col("na") - F.col("at"), n - F.col("place")), percent))
    need = F.least(F.lit(2), shared_with_any_sql(F.col("na"), percent)).cast("long")
    return met.select("a", F.col("c").alias("b"), F.col("n").alias("nb"), need.alias("need"), F.lit(1).cast("long").alias("times"))


def rooted(live: DataFrame, roots: DataFrame | None) -> DataFrame:
    """live with the root and the size of each class's component; a class without a link is its own."""
    if roots is None:
        return live.withColumns({"root": F.col("c"), "size": F.lit(1).cast("long")})
    sized = roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").select("c", "root", "size")
    return live.select(*POSTING).join(shared.sent_if_small(sized, MOST_SENT), "c", "left").select(*POSTING, F.coalesce("root", "c").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))


def apart(live: DataFrame, percent: int, hot: bool) -> DataFrame:
    """a and root: the classes of each list, each with the other components there that are larger (of equal ones, of larger root)
    and have a class in this list that it can link with. live has the columns root and size of the component."""

    def run(batches):
        for x, begin, end in lists(batches, (*POSTING, "root", "size")):
            a, need, roots = [], [], []
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                members = np.arange(lo, hi)
                if (x["root"][lo:hi] == x["root"][lo]).all():
                    continue
                top = members[np.lexsort((x["root"][lo:hi], x["size"][lo:hi]))[-1]]
                for i in members[x["root"][lo:hi] != x["root"][top]].tolist():
                    larger = (x["size"][lo:hi] > x["size"][i]) | ((x["size"][lo:hi] == x["size"][i]) & (x["root"][lo:hi] > x["root"][i]))
                    js = members[larger]
                    js = js[may_link(x, i, js, percent)]
                    if len(js):
                        a.append(int(x["c"][i]))
                        need.append(int(shared_with_any(int(x["n"][i]), percent)))
                        roots.append(np.unique(x["root"][js]).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(need, pa.int64()), pa.array(roots, pa.binary())], ["a", "need", "roots"])

    def often(batches):
        """If a links with a class of a component, they share ``need`` lists."""
        one, need, held = None, 0, []

        def enough():
            found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, int))
            found = found[times >= need]
            return np.full(len(found), one if one is not None else 0, np.int64), found

        for batch in batches:
            out = []
            for c, least, roots in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != one:
                    out.append(enough())
                    one, need, held = c, least, []
                held.append(np.frombuffer(roots, np.int64))
            both = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in both], ["a", "root"])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in enough()], ["a", "root"])

    found = in_lists(live.where("of = 1") if hot else live).mapInArrow(run, "a long, need long, roots binary")
    found = found.repartition("a").sortWithinPartitions("a").mapInArrow(often, "a long, root long")
    return found.unionByName(apart_in_sublists(live.where("of > 1"), percent)).distinct() if hot else found


def apart_in_sublists(live: DataFrame, percent: int) -> DataFrame:
    """The same for lists in sublists: each sublist's classes meet the components of the whole list. What these have in it is told
    by the ends of its sizes, so some are asked in vain; a pair that has one such list counts, as it may have the others elsewhere."""
    n, size = F.col("n").cast("long"), F.col("size")
    summary = live.groupBy("token", "of", F.col("root").alias("to")).agg(
        F.max("size").alias("to_size"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(n - F.col("place")).alias("left")
    )
    met = live.join(to_sublists(summary), ["token", "salt"]).where((F.col("to_size") > size) | ((F.col("to_size") == size) & (F.col("to") > F.col("root"))))
    least, most = F.greatest(F.col("least"), up(percent * n, 100)), F.least(F.col("most"), F.floor(100 * n / percent))
    before = F.least(shared_first_sql(n, percent), shared_first_sql(most, percent)) - 1
    fits = (least <= most) & (F.least(n - F.col("place"), F.col("left")) + before >= up(percent * (n + least), 100 + percent))
    return met.where(fits).select(F.col("c").alias("a"), F.col("to").alias("root")).distinct()


class Index:
    """The inverted lists of some sets: for each shingle the numbers of the sets that have it, in order."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.size, self.percent = np.array([len(s) for s in sets], np.int64), percent
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.tokens, self.begin = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.begin[1:], len(tokens))

    def links(self, query: np.ndarray, mu: float = 0.01) -> Iterator[int]:
        """DivideSkip: the numbers of the sets that link with the query.

        The query's longest lists are set apart, and the others merged by a heap. What occurs there often enough to reach
        its T with the long lists is looked up in these by binary search, as long as it still can.
        """
        n = len(query)
        fits = (self.percent * np.maximum(n, self.size) <= 100 * np.minimum(n, self.size))
        if not fits.any():
            return
        wanted = overlap(n, self.size, self.percent)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        at = at[np.argsort(self.end[at] - self.begin[at], kind="stable")]
        least = int(wanted[fits].min())
        if len(at) < least:
            return
        longest = int(self.end[at[-1]] - self.begin[at[-1]])
        n_long = min(least - 1, int(least / (mu * log2(max(longest, 2)) + 1)), len(at))
        short, long = ([self.owner[a:b] for a, b in zip(self.begin[x], self.end[x], strict=True)] for x in (at[: len(at) - n_long], at[len(at) - n_long :]))
        found = [(c, sum(1 for _ in times)) for c, times in groupby(heapq.merge(*[x.tolist() for x in short]))]
        if not found:
            return
        one, count = (np.array(v, np.int64) for v in zip(*found, strict=True))
        alive = fits[one] & (count + len(long) >= wanted[one])
        one, count = one[alive], count[alive]
        for k, x in enumerate(long, 1):
            if not len(one):
                return
            place = np.minimum(np.searchsorted(x, one), len(x) - 1)
            count = count + (x[place] == one)
            alive = count + len(long) - k >= wanted[one]
            if not alive.all():
                one, count = one[alive], count[alive]
        yield from one[100 * count >= self.percent * (n + self.size[one] - count)].tolist()


def asked(rows: DataFrame, percent: int, one_is_enough: bool) -> DataFrame:
    """u, v: the links of the sets that ask with those of the index of their block. rows: block, part, asks, c and s, a set as the bytes of 64-bit integers."""

    def run(batches):
        key, names, held, index = None, [], [], None
        for batch in batches:
            links = []
            for block, part, asks, c, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (block, part) != key:
                    key, names, held, index = (block, part), [], [], None
                if not asks:
                    names.append(c)
                    held.append(np.frombuffer(s, np.uint64))
                    continue
                if index is None and held:
                    index, held = Index(held, percent), []
                for k in index.links(np.frombuffer(s, np.uint64)) if index else ():
                    links.append((c, names[k]))
                    if one_is_enough:
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    together = rows.select("block", "part", "asks", "c", "s").repartition("block", "part").sortWithinPartitions("block", "part", "asks", "c")
    return together.mapInArrow(run, "u long, v long")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b, nb the links. Each a asks indexes of its b's, of a bounded number of shingles each."""
    parts = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / F.lit(AT_A_TIME)).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select(F.col("a").alias("block"), "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    held = dealt.withColumnRenamed("b", "c").join(sets, "c").withColumn("asks", F.lit(False))
    asking = dealt.select("block", "part").distinct().withColumn("c", F.col("block")).join(sets, "c").withColumn("asks", F.lit(True))
    return asked(held.unionByName(asking), percent, False)


def checked_apart(found: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of a, root the links, one for each of them at least if there is any. members: c and root; each component is an index, in parts of a
    bounded number of shingles, that each a asks."""
    with_sets = members.join(found.select("root").distinct(), "root", "left_semi").join(sets, "c")
    parts = with_sets.groupBy("root").agg(F.ceil(F.sum(F.octet_length("s") / F.lit(8)) / F.lit(AT_A_TIME)).cast("int").alias("parts"))
    held = with_sets.join(parts, "root").select(
        F.col("root").alias("block"), F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "c", "s"
    )
    asking = found.join(parts, "root").select(F.col("root").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("c"))
    return asked(held.unionByName(asking.join(sets, "c").select("block", "part", F.lit(True).alias("asks"), "c", "s")), percent, True)


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, work: shared.Workspace) -> DataFrame:
    """c and s for each class c of wanted: the sets of one document of each, made again from its text."""
    ids = work.written(wanted.select("c").distinct().join(classes, "c").select("c", "key"), "wanted")
    some = keyed(docs).join(shared.sent_if_small(ids.select("key"), MOST_SENT), "key", "left_semi")

    def run(batches):
        for batch in batches:
            for t in texts(batch.column(1), lower=True):
                found = [(class_of(s), s.tobytes()) for s in shingles(t, n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["c", "s"])

    return some.select("key", "text").mapInArrow(run, "c long, s binary").dropDuplicates(["c"])


def more_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, sets: DataFrame | None, n: int, work: shared.Workspace) -> DataFrame:
    """sets, and those of the other classes wanted."""
    if sets is None:
        return work.written(sets_of(docs, classes, wanted, n, work), "sets")
    return sets.unionAll(work.written(sets_of(docs, classes, wanted.join(sets.select("c"), "c", "left_anti"), n, work), "sets"))


def linked(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """c and root of the components that roots, as far as there are any, and links u, v give together."""
    if roots is not None:
        if links.limit(1).count() == 0:
            return roots
        links = links.unionAll(roots.select("c", "root"))
    return components(links).withColumnRenamed("node", "c")


def joined(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """key, doc_id, hash, n_shingles, root (a number of the component; null for the empty set) and component_id of each
    document; documents link at ``percent`` of 100 or more. It is a table in the shared folder."""
    with shared.Workspace(docs.sparkSession, "ngram-join") as work:
        return shared.written(_joined(docs, n, percent, work), "joined")


def _joined(docs: DataFrame, n: int, percent: int, work: shared.Workspace) -> DataFrame:
    found = work.written(described(docs, n), "described")
    top = found.where("token is not null").groupBy("token").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "token").limit(MOST_FREQUENT).toArrow()
    tokens, often = top["token"].to_numpy().view(np.uint64), top["often"].to_numpy()
    order = np.argsort(tokens)
    rows = found.where("token is null").drop("token", "often")
    classes = work.written(rows.where("c is not null").groupBy("c").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id")), "classes")
    live = work.written(shared_lists(postings(docs, n, percent, (tokens[order], often[order]))), "postings")
    enough = shared.sent_if_small(work.written(in_enough_lists(live, percent), "enough"), MOST_SENT)
    live = work.rewritten(live.join(enough, "c", "left_semi").select(*POSTING), "postings")
    hot = live.where("of > 1").limit(1).count() > 0

    roots = sets = tried = None
    for turn, centers in enumerate(CENTERS):
        pairs = stars(rooted(live, roots), percent, centers, turn, hot)
        pairs = work.written(pairs if tried is None else pairs.join(tried, ["lo", "hi"], "left_anti"), "pairs")
        tried = pairs.select("lo", "hi") if tried is None else tried.unionAll(pairs.select("lo", "hi"))
        sets = more_sets(docs, classes, pairs.select(F.col("a").alias("c")).unionAll(pairs.select("b")), sets, n, work)
        roots = linked(roots, work.written(checked(pairs, sets, percent), "links"))

    rest = apart(rooted(live, roots), percent, hot).withColumns({"lo": F.least("a", "root"), "hi": F.greatest("a", "root")})
    # a class without a link is its own component, and may have been tried with a before
    alone = rest.join(roots.select("root").distinct(), "root", "left_anti").join(tried, ["lo", "hi"], "left_anti")
    whole = rest.join(roots.select("root").distinct(), "root", "left_semi")
    rest = work.written(alone.select("a", "root").unionAll(whole.select("a", "root")), "apart")
    asked_for = rest.select("root").distinct()
    single = asked_for.join(roots, "root", "left_anti").select(F.col("root").alias("c"), "root")
    members = work.written(roots.join(asked_for, "root", "left_semi").select("c", "root").unionAll(single), "members")
    sets = more_sets(docs, classes, rest.select(F.col("a").alias("c")).unionAll(members.select("c")), sets, n, work)
    late = work.written(checked_apart(rest, members, sets, percent), "links")
    roots = linked(roots, late)

    of_class = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(least, "root").select("c", "root", "component_id")
    same = ["key", "doc_id", "hash", F.col("n").alias("n_shingles")]
    full = rows.where("c is not null").join(named, "c", "left").select(*same, "root", "component_id")
    empty = rows.where("c is null").select(*same, F.col("c").alias("root"), F.col("doc_id").alias("component_id"))
    return full.unionAll(empty)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but one of each component: the one with the smallest doc_id stays, of equal rows one."""
    key, hash_ = shared.unused(docs.columns, "key", "hash")
    found = joined(docs, n, percent).where("root is not null")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "key", "hash")).alias("least"))
    met = found.join(least, "root").withColumn("stays", (F.col("key") == F.col("least.key")) & (F.col("hash") == F.col("least.hash")))
    gone = shared.written(met.where("not stays").select(F.col("key").alias(key), F.col("hash").alias(hash_)).distinct(), "gone")
    ids = identity()
    kept = docs.withColumns({key: ids["key"], hash_: ids["hash"]}).join(shared.sent_if_small(gone, MOST_SENT), [key, hash_], "left_anti")
    repeats = met.where("stays").groupBy("key", "hash").count().where("count > 1").limit(1).count()
    if repeats:  # equal rows have nothing that tells them apart
        words = F.regexp_like(shared.whole_text(), F.lit("[^\\x20\\x09-\\x0D]"))
        kept = kept.where(words).dropDuplicates([key, hash_]).unionAll(kept.where(~words))
    return kept.select(*shared.own_columns(docs))
