"""Quality rules whose thresholds are set under a bound on false rejections.

Labelled documents are parted by a hash. An eighth of the good ones, and all bad ones, set the order in which cutoffs
are tightened, one cutoff of one rule at a step: what catches most bad documents for each good one comes first. The
other good documents then tell, for each stratum, how many of them the rules of each step reject together. Steps are
tested in their order, up to the first failure, so no level is spent on the number of rules or cutoffs: a step is
allowed where an exact binomial test at level ``delta / strata`` shows that all rules together reject at most ``risk``
of the good documents of that stratum. So the bound holds in all strata at once with probability ``1 - delta``. Strata
with too few labels for any outcome to pass are not tested, and the rules reject nothing there.

Cases: a null text has no words; a null stratum is a stratum of its own; null, repeated or contradictory labels
count once as good only if every label of that document is good; an empty holdout rejects by the base rules alone;
rows may repeat and columns may have any other names; an empty table gives an empty result; two documents of one value are
on the same side of a cutoff, as a rule rejects what is above it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .text import texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: So many of them are those of the base.
BASE_COUNTS = 5
MEASURES = T.StructType([T.StructField(x, T.LongType()) for x in COUNTS])


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    out: dict[str, list[np.ndarray]] = {x: [] for x in COUNTS}
    for t in texts(column):
        out["n_words"].append(t.n_words)
        out["word_chars"].append(t.bytes_per_text(t.is_word & ~CONTINUES[t.data]))
        out["n_symbols"].append(t.bytes_per_text(SYMBOLS[t.data]))
        out["n_upper"].append(t.bytes_per_text(UPPER[t.data]))
        out["n_marks"].append(t.bytes_per_text(MARKS[t.data]))
        # lines that have a word, by the text that they are in
        breaks = np.flatnonzero(t.data == 10)
        starts = np.unique(np.concatenate([t.offsets[:-1], breaks + 1]))
        starts = starts[starts < len(t.data)]
        stops = np.minimum(
            np.append(starts[1:], len(t.data)), t.offsets[np.searchsorted(t.offsets, starts, "right")]
        )
        stops = np.where(t.data[stops - 1] == 10, stops - 1, stops)
        has_word = np.searchsorted(t.starts, stops) > np.searchsorted(t.starts, starts)
        starts, stops = starts[has_word], stops[has_word]
        of = np.searchsorted(t.offsets, starts, "right") - 1
        out["n_lines"].append(np.bincount(of, minlength=len(t)))
        out["n_dup_lines"].append(np.bincount(of[~first_ones(t.hashes(starts, stops), of)], minlength=len(t)))
        # words in windows that the text has again
        windows, full = t.windows(t.word_hashes(), 3)
        again = np.zeros(len(windows), bool)
        at = np.flatnonzero(full)
        again[at[repeated(windows[at], np.repeat(np.arange(len(t)), t.n_words)[at])]] = True
        covered = again.copy()
        covered[1:] |= again[:-1]
        covered[2:] |= again[:-2]
        out["n_repeat_words"].append(t.per_text(covered))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def keyed(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hashes ^ ((of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def first_ones(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which are the first of their value in their text."""
    out = np.zeros(len(hashes), bool)
    out[np.unique(keyed(hashes, of), return_index=True)[1]] = True
    return out


def repeated(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which have a value that their text has twice or more."""
    keys = keyed(hashes, of)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


@F.arrow_udf(MEASURES)
def measures(column: pa.Array) -> pa.Array:
    found = counts(column)
    return pa.StructArray.from_arrays([pa.array(found[x], pa.int64()) for x in COUNTS], list(COUNTS))


@dataclass(frozen=True)
class Rule:
    """Rejects where top / bottom exceeds a cutoff; the grid of cutoffs is fixed before any label is seen."""

    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]

    def value(self, m: str) -> Column:
        bottom = F.col(f"{m}.{self.bottom}")
        return F.when(bottom > 0, F.col(f"{m}.{self.top}") / bottom).otherwise(F.lit(0.0))


SHARES = tuple(k / 40 for k in range(1, 40))
RULES = (
    Rule("symbols", "n_symbols", "word_chars", SHARES),
    Rule("marks", "n_marks", "word_chars", SHARES),
    Rule("upper", "n_upper", "word_chars", SHARES),
    Rule("dup_lines", "n_dup_lines", "n_lines", SHARES),
    Rule("repeats", "n_repeat_words", "n_words", SHARES),
    Rule("word_length", "word_chars", "n_words", tuple(4.0 + k / 2 for k in range(40))),
)


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n and p; exact up to rounding."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0 - sum_down(n - k - 1, n, 1.0 - p)
    return sum_down(k, n, p)


def sum_down(k: int, n: int, p: float) -> float:
    total, j = 0.0, k
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    while j >= 0 and term > total * 1e-17:
        total += term
        term *= j / (n - j + 1) * (1 - p) / p
        j -= 1
    return min(1.0, total)


def lowest_safe(above: list[int], n: int, cutoffs: tuple[float, ...], risk: float, level: float) -> float | None:
    """The lowest cutoff such that, were ``risk`` or more of the good documents above it, so few of n would be so
    with probability ``level`` at most."""
    for c, k in zip(cutoffs, above, strict=True):
        if n and at_most(k, n, risk) <= level:
            return c
    return None


def fit(
    docs: DataFrame,
    labels: DataFrame,
    measured: str,
    stratum: str = "lang",
    risk: float = 0.02,
    delta: float = 0.05,
    rules: tuple[Rule, ...] = RULES,
    most: int = 100_000,
) -> DataFrame:
    """A row for each stratum: stratum, and a cutoff for each rule (null: rejects nothing).

    docs has doc_id, the stratum and the struct ``measured``; labels has doc_id and quality (1: good). The order of the steps is
    learned from at most ``most`` labelled documents, the first by a hash; all other good ones are in the tests, whatever their number.
    """
    is_good = F.col("quality") == 1
    known = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce(is_good, F.lit(False))).alias("good"), (~F.max(F.coalesce(is_good, F.lit(True)))).alias("bad"))
        .where("good or bad")
        .select(F.col("doc_id").alias("__id"), "good")
    )
    held = docs.select(
        F.col("doc_id").alias("__id"), F.col(stratum).cast("string").alias("stratum"), base_failed(measured).alias("base"), *[r.value(measured).alias(r.name) for r in rules]
    ).join(known, "__id")
    # of several rows of a document the largest values count, once
    held = held.groupBy("__id", "good").agg(F.min("stratum").alias("stratum"), F.max("base").alias("base"), *[F.max(r.name).alias(r.name) for r in rules])
    with shared.Workspace(docs.sparkSession, "quality-rules") as work:
        held = work.written(held.withColumn("orders", ~F.col("good") | (F.pmod(F.xxhash64("__id", F.lit("order")), F.lit(ORDERING)) == 0)), "held")
        return _chosen(held, work, risk, delta, rules, most)


def _chosen(held: DataFrame, work: shared.Workspace, risk: float, delta: float, rules: tuple[Rule, ...], most: int) -> DataFrame:
    """The cutoffs, as a table. held: stratum, good, base, orders and the value of each rule, for each labelled document."""
    above = [sum((F.col(r.name) > c).cast("int") for c in r.cutoffs).alias(r.name) for r in rules]
    some = held.where("orders and (good or not base)").orderBy(F.xxhash64("__id"), "__id").limit(most)
    ordering = some.select("good", *above).groupBy("good", *[r.name for r in rules]).count().toPandas()
    steps = order(ordering[[r.name for r in rules]].to_numpy(np.int64), ordering["good"].to_numpy(bool), ordering["count"].to_numpy(np.int64), rules, risk)
    first = [first_step(r, [(c, j) for j, (i, c) in enumerate(steps) if rules[i] is r]) for r in rules]
    tally = held.where("good and not orders").select("stratum", F.least(*first, F.lit(None).cast("int")).alias("first")).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("first") <= j).alias(f"step_{j}") for j in range(len(steps))]
    )
    tally = work.written(tally, "tally")
    # the level of each test falls with the number of strata that are tested
    tested = tally.where(F.col("n") >= math.log(delta) / math.log1p(-risk)).count()
    level = delta / max(1, tested)
    kind = "stratum string, " + ", ".join(f"{r.name} double" for r in rules)

    def choose(batches):
        for x in batches:
            rows = []
            for row in x.to_dict("records"):
                last = range(len(steps) - 1, -1, -1)
                safe = lowest_safe([row[f"step_{j}"] for j in last], row["n"], tuple(last), risk, level)
                out = dict.fromkeys([r.name for r in rules]) | {"stratum": row["stratum"]}
                out |= {rules[i].name: c for i, c in steps[: 0 if safe is None else safe + 1]}
                rows.append(out)
            yield pd.DataFrame(rows, columns=["stratum", *[r.name for r in rules]]).astype({r.name: float for r in rules})

    return shared.written(tally.mapInPandas(choose, kind), "cutoffs")


#: One of so many good documents sets the order of the steps, and is not in the tests.
ORDERING = 8


def order(above: np.ndarray, good: np.ndarray, count: np.ndarray, rules: tuple[Rule, ...], risk: float) -> list[tuple[int, float]]:
    """(rule, cutoff) of each step. above: how many of each rule's cutoffs a document exceeds; count: how many documents are so.

    Takes the cutoff that adds most bad documents for each good one, the loosest of equals, and comes to it by all looser
    ones of its rule; leaves out what would reject more than ``risk`` of these good documents.
    """
    steps, at = [], [len(r.cutoffs) for r in rules]
    room = risk * count[good].sum()
    while True:
        best = (0.0, -1, -1)
        for i, r in enumerate(rules):
            n = len(r.cutoffs)
            # of cutoff k: the documents that are left and exceed it
            bads, goods = (np.cumsum(np.bincount(above[x, i], count[x], n + 1)[::-1])[::-1][1:] for x in (~good, good))
            score = np.where((goods <= room) & (np.arange(n) < at[i]), bads / (goods + 1.0), 0.0)
            k = n - 1 - int(np.argmax(score[::-1]))
            if score[k] > best[0]:
                best = (score[k], i, k)
        _, i, k = best
        if i < 0:
            return steps
        steps += [(i, rules[i].cutoffs[j]) for j in range(at[i] - 1, k - 1, -1)]
        at[i], gone = k, above[:, i] > k
        room -= count[gone & good].sum()
        above, good, count = above[~gone], good[~gone], count[~gone]


def first_step(rule: Rule, taken: list[tuple[float, int]]) -> Column:
    """The step from which on the rule rejects a document; null if it never does. taken: its cutoffs, the loosest first, and their steps."""
    out = F.lit(None).cast("int")
    for c, j in reversed(taken):
        out = F.when(F.col(rule.name) > c, F.lit(j)).otherwise(out)
    return out


def base_failed(measured: str) -> Column:
    m = F.col(measured)
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judged(docs: DataFrame, cuts: DataFrame, measured: str, base_name: str, kept_name: str, stratum: str = "lang", rules=RULES, most: int = 100_000) -> DataFrame:
    """docs with two columns more. cuts: a row for each stratum; sent to every executor if ``most`` rows or fewer."""
    of, cut = shared.unused([*docs.columns, base_name, kept_name], "of", "cut")
    cuts = shared.sent_if_small(cuts.select(F.col("stratum").alias(of), F.struct(*[r.name for r in rules]).alias(cut)), most)
    base, over = base_failed(measured), F.lit(False)
    for r in rules:
        over = over | F.coalesce(r.value(measured) > F.col(f"{cut}.{r.name}"), F.lit(False))
    met = docs.join(cuts, docs[stratum].cast("string").eqNullSafe(F.col(of)), "left")
    return met.withColumns({base_name: base, kept_name: ~base & ~over}).drop(of, cut)


def rated(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, n_words and the counts of the base, base_failed and kept of each document; then the other counts."""
    found = shared.written(docs.select("doc_id", "lang", measures(shared.whole_text()).alias("m")), "measures")
    out = judged(found, fit(found, labels, "m", **how), "m", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"m.{x}") for x in COUNTS[:BASE_COUNTS]], "base_failed", "kept", *[F.col(f"m.{x}") for x in COUNTS[BASE_COUNTS:]])


def passing(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with their own columns only. Each text is measured once, and written beside its counts."""
    m, base, kept = shared.unused(docs.columns, "m", "base_failed", "kept")
    found = shared.written(docs.select(*shared.own_columns(docs), measures(shared.whole_text()).alias(m)), "measured")
    return judged(found, fit(found, labels, m, **how), m, base, kept).where(F.col(kept)).select(*shared.own_columns(docs))
