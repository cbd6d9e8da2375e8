"""Token arrays: a hashing tokenizer for plans, response-only labels, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def token_ids(text: Column, vocabulary: int = 32_000) -> Column:
    """An id for each word between white space, by a hash."""
    words = F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: F.length(w) > 0)
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % vocabulary))


def tokenize(df: DataFrame, max_length: int = 2048, response_only: bool = True) -> DataFrame:
    """input_ids, attention_mask and labels, instead of the text columns. Of prompt and response, the prompt's labels are ignored."""
    texts = [c for c in ("prompt", "response", "text") if c in df.columns]
    others = [c for c in df.columns if c not in texts]
    both = {"prompt", "response"} <= set(texts)
    whole = F.concat("prompt", "response") if both else F.coalesce(*[F.col(c) for c in ("text", "prompt") if c in texts], F.lit(""))
    out = df.withColumn("input_ids", F.slice(token_ids(whole), 1, max_length))
    labels = F.col("input_ids")
    if both and response_only:
        out = out.withColumn("__masked", F.least(F.size(token_ids(F.col("prompt"))), F.lit(max_length)))
        labels = F.transform("input_ids", lambda x, i: F.when(i < F.col("__masked"), F.lit(IGNORE)).otherwise(x))
    return out.withColumns({"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "labels": labels}).select(*others, "input_ids", "attention_mask", "labels")


def distinct_in_order(*arrays: Column) -> Column:
    """The values of some arrays, one array after the other, each value where it comes first."""
    return F.array_distinct(F.concat(*arrays))


def pad(df: DataFrame, batch: str, multiple: int = 1, pad_id: int = 0) -> DataFrame:
    """Arrays as long as the longest of their batch, rounded up to a multiple: ids by pad_id, mask by 0, labels ignored."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    out = df.withColumn("__to", (F.ceil(longest / multiple) * multiple).cast("int"))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("__to") - F.size(c)))
    return out.withColumns({"input_ids": fill("input_ids", pad_id), "attention_mask": fill("attention_mask", 0), "labels": fill("labels", IGNORE)}).drop("__to")
