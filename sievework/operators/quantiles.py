"""Exact order statistics without a task that holds all values.

A KLL sketch, of a bounded size however many rows there are, brackets the rank that is asked for; counts of all rows say how many lie before the
bracket and in it; and what lies inside is bracketed again, until it is few enough to sort. The sketch decides only how soon that is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are sorted at once; the sketch's size, and the share of ranks by which each end of a bracket is moved out: some four times the sketch's usual error.
FEW, SKETCH, SLACK = 20_000, 4096, 0.003


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """The values of these ranks, from 0, in ascending order. Nulls and NaN have none. df is read several times, so its values must be the same each
    time, as those of a table are; ranks that lie close together share a bracket."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    return _within(values, values.count(), sorted(set(ranks)), ranks)


def _within(values: DataFrame, n: int, wanted: list[int], ranks: Sequence[int]) -> list[float]:
    if wanted and not 0 <= wanted[0] <= wanted[-1] < n:
        raise ValueError(f"there are {n} values, so none of rank {wanted[-1] if wanted[-1] >= n else wanted[0]}")
    found: dict[int, float] = {}
    todo = [(values, n, 0, wanted)] if wanted else []  # values, how many, how many lie before them, and the ranks that lie in them
    while todo:
        inside, n, before, some = todo.pop()
        if n <= FEW:
            ordered = sorted(r["x"] for r in inside.collect())
            found |= {r: ordered[r - before] for r in some}
            continue
        sketch = inside.agg(F.kll_sketch_agg_double("x", SKETCH).alias("s"))
        at = lambda r: F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, r))))
        ends = [((r - before) / n - SLACK, (r - before) / n + SLACK) for r in some]
        found_ends = sketch.select(*[at(e).alias(f"c{i}_{j}") for i, pair in enumerate(ends) for j, e in enumerate(pair)]).first()
        brackets = []
        for i, r in enumerate(some):
            low, high = found_ends[f"c{i}_0"], found_ends[f"c{i}_1"]
            if brackets and low <= brackets[-1][1]:
                brackets[-1] = (brackets[-1][0], max(high, brackets[-1][1]), [*brackets[-1][2], r])
            else:
                brackets.append((low, high, [r]))
        x = F.col("x")
        counts = inside.agg(*[F.count_if(c).alias(f"c{i}_{j}") for i, (low, high, _) in enumerate(brackets) for j, c in enumerate((x < low, x <= low, x < high, x <= high))]).first()
        for i, (low, high, mine) in enumerate(brackets):
            stops = [before, *(before + counts[f"c{i}_{j}"] for j in range(4)), before + n]
            # before low, low itself, between, high itself, after high
            parts = [inside.where(x < low), None, inside.where((x > low) & (x < high)), None, inside.where(x > high)]
            for j, (part, value) in enumerate(zip(parts, (None, low, None, high, None), strict=True)):
                here = [r for r in mine if stops[j] <= r < stops[j + 1]]
                if here and part is None:
                    found |= dict.fromkeys(here, value)
                elif here:
                    todo.append((part, stops[j + 1] - stops[j], stops[j], here))
    return [found[r] for r in ranks]


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The values below which these shares of the rows lie, by linear interpolation between the two nearest ranks; None without values."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = values.count()
    if not n:
        return [None] * len(shares)
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, _within(values, n, ranks, ranks), strict=True))
    low = [(math.floor(p), p - math.floor(p)) for p in places]
    return [value[r] if not part else value[r] + part * (value[r + 1] - value[r]) for r, part in low]
