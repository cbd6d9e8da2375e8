"""Benchmarks: accuracy of choices and of numbers, and the rows of those that need a model at hand."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import best_choice, final_number


def choice_accuracy(scored: DataFrame, scores: str = "scores", answer: str = "answer", subject: str = "subject") -> DataFrame:
    """subject, accuracy and total, and the same over all with a null subject."""
    right = (best_choice(F.col(scores)) == F.col(answer)).cast("double")
    return scored.withColumn("__right", right).rollup(subject).agg(F.avg("__right").alias("accuracy"), F.count(F.lit(1)).alias("total"))


def number_accuracy(answers: DataFrame, said: str = "said", truth: str = "truth") -> DataFrame:
    """accuracy, correct and total: the final numbers of both texts are there and differ by less than 1e-6."""
    both = answers.select((F.abs(final_number(F.col(said)) - final_number(F.col(truth))) < 1e-6).alias("right"))
    sums = both.agg(F.count_if("right").alias("correct"), F.count(F.lit(1)).alias("total"))
    return sums.select(F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0)).alias("accuracy"), "correct", "total")


#: Benchmarks that run code or ask a judge model; without one their score is 0 and the note says so.
NEED_A_MODEL = {"humaneval": "pass@1 needs code to be run", "mt_bench": "needs a judge model", "alpaca_eval": "needs a judge model"}


def evaluate(spark: SparkSession, names: list[str], ready: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """benchmark, accuracy and note; ready gives a frame with one accuracy for a benchmark. Unknown names are left out."""
    out = spark.createDataFrame([(n, 0.0, NEED_A_MODEL[n]) for n in names if n in NEED_A_MODEL and n not in ready], "benchmark string, accuracy double, note string")
    for n in names:
        if n in ready:
            out = out.unionByName(ready[n]().select(F.lit(n).alias("benchmark"), "accuracy", F.lit("").alias("note")))
    return out
