"""Queries over chat records, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, tokens
from ..operators import ngrams, sampling, selectors
from ..sources.tables import ordered_turns, table
from .registry import query

CHATS = "conversations"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_turns(table(spark, sf_dir, CHATS))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records of the chats: first user turn, second user turn (or none), first assistant turn."""
    of = lambda role: F.filter("messages", lambda m: m["role"] == role)
    at = lambda a, k: F.get(a, F.lit(k))["content"]
    return chats(spark, sf_dir).select(
        "conv_id", at(of("user"), 0).alias("instruction"), at(of("user"), 1).alias("input"), at(of("assistant"), 0).alias("output")
    )


INSTRUCTIONS = """
i AS (SELECT conv_id, list(text ORDER BY turn, role, text) FILTER (WHERE role = 'user') AS u, list(text ORDER BY turn, role, text) FILTER (WHERE role = 'assistant') AS a
  FROM conversations GROUP BY conv_id),
ins AS (SELECT conv_id, u[1] AS instruction, u[2] AS input, a[1] AS output FROM i)"""

ALPACA = f"""
WITH {INSTRUCTIONS},
p AS (SELECT conv_id, CASE WHEN length(input) > 0
    THEN '{records.WITH_INPUT}' || chr(10) || chr(10) || '### Instruction:' || chr(10) || coalesce(instruction, '') || chr(10) || chr(10) || '### Input:' || chr(10) || input
    ELSE '{records.WITHOUT_INPUT}' || chr(10) || chr(10) || '### Instruction:' || chr(10) || coalesce(instruction, '') END
    || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt, coalesce(output, '') AS response FROM ins)
SELECT conv_id, prompt, response, prompt || response AS text FROM p"""


@query("normalize_alpaca", ALPACA)
def normalize_alpaca(spark, sf_dir):
    return records.normalize(instructions(spark, sf_dir), "alpaca").select("conv_id", "prompt", "response", "text")


SHAREGPT = """
t AS (SELECT conv_id,
    string_agg(CASE WHEN role IN ('human', 'user') THEN '### Human:' || chr(10) || text || chr(10)
      WHEN role IN ('gpt', 'assistant') THEN '### Assistant:' || chr(10) || text || chr(10) ELSE '' END, '' ORDER BY turn, role, text) AS prompt,
    coalesce((list(text ORDER BY turn, role, text) FILTER (WHERE role IN ('gpt', 'assistant') AND text <> ''))[1], '') AS response
  FROM conversations GROUP BY conv_id)"""


@query("normalize_sharegpt", f"WITH {SHAREGPT} SELECT conv_id, prompt, response, prompt AS text FROM t")
def normalize_sharegpt(spark, sf_dir):
    return records.normalize(chats(spark, sf_dir), "sharegpt").select("conv_id", "prompt", "response", "text")


CHATML = """
WITH t AS (SELECT conv_id,
    string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) ELSE '' END, '' ORDER BY turn, role, text) AS prompt,
    coalesce((list(text ORDER BY turn, role, text) FILTER (WHERE role = 'assistant' AND text <> ''))[1], '') AS response
  FROM conversations GROUP BY conv_id)
SELECT conv_id, prompt, response, prompt || CASE WHEN response <> '' THEN '<|assistant|>' || chr(10) || response || '<|end|>' ELSE '' END AS text FROM t"""


@query("normalize_chatml", CHATML)
def normalize_chatml(spark, sf_dir):
    return records.normalize(chats(spark, sf_dir), "chatml").select("conv_id", "prompt", "response", "text")


STRICT = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
f AS (SELECT conv_id, min(k) AS first FROM t WHERE role = 'assistant' AND text <> '' GROUP BY conv_id),
p AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN '### Human:' || chr(10) || text || chr(10)
      WHEN role = 'assistant' THEN '### Assistant:' || chr(10) || text || chr(10) ELSE '' END, '' ORDER BY k) FILTER (WHERE first IS NULL OR k < first), '')
      || CASE WHEN max(first) IS NULL THEN '' ELSE '### Assistant:' || chr(10) END AS prompt,
    coalesce(max(text) FILTER (WHERE k = first), '') AS response
  FROM t LEFT JOIN f USING (conv_id) GROUP BY conv_id)
SELECT conv_id, prompt, response, prompt || response AS text FROM p"""


@query("normalize_sharegpt_strict", STRICT)
def normalize_sharegpt_strict(spark, sf_dir):
    return records.sharegpt(chats(spark, sf_dir), strict=True).select("conv_id", "prompt", "response", "text")


IDS = "list_transform(list_filter(string_split_regex({0}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: length(w) > 0), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 7) AS INTEGER) % 32000 AS INTEGER))"
TOKENS = f"""
WITH {SHAREGPT},
k AS (SELECT conv_id, ({IDS.format("prompt || response")})[1:2048] AS input_ids, least(len({IDS.format("prompt")}), 2048) AS masked FROM t)"""


@query(
    "tokenize_mask",
    TOKENS + "SELECT conv_id, input_ids, list_transform(input_ids, lambda x: 1) AS attention_mask, list_transform(input_ids, lambda x, i: CASE WHEN i <= masked THEN -100 ELSE x END) AS labels FROM k",
)
def tokenize_mask(spark, sf_dir):
    return tokens.tokenize(normalize_sharegpt(spark, sf_dir)).select("conv_id", "input_ids", "attention_mask", "labels")


PAD = (
    TOKENS
    + """, m AS (SELECT *, conv_id // 8 AS batch FROM k), w AS (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch) / 8) * 8 AS INTEGER) AS t FROM m)
SELECT conv_id, batch, list_resize(input_ids, t, 0) AS input_ids, list_resize(list_transform(input_ids, lambda x: 1), t, 0) AS attention_mask,
  list_resize(list_transform(input_ids, lambda x, i: CASE WHEN i <= masked THEN -100 ELSE x END), t, -100) AS labels FROM w"""
)


@query("pad_batch", PAD)
def pad_batch(spark, sf_dir):
    batched = tokenize_mask(spark, sf_dir).withColumn("batch", F.expr("conv_id div 8"))
    return tokens.pad(batched, "batch", 8)


VALIDATION = f"""
WITH {INSTRUCTIONS}
SELECT conv_id, CASE WHEN length(output) > 0 THEN 'Question: ' || coalesce(instruction, '') || chr(10) || 'Answer: ' || output
  ELSE coalesce(nullif(instruction, ''), nullif(input, ''), '') END AS text FROM ins"""


@query("validation_text", VALIDATION)
def validation_text(spark, sf_dir):
    rows = instructions(spark, sf_dir).select("conv_id", F.col("instruction").alias("question"), F.col("input").alias("prompt"), F.col("output").alias("answer"))
    return rows.select("conv_id", records.validation_text(rows).alias("text"))


GRAMS = "SELECT doc_id, unnest(list_transform(range(1, length(lower(text)) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM documents"


@query("ngram_counts", f"WITH g AS ({GRAMS}) SELECT gram, count(*) AS cnt FROM g GROUP BY gram ORDER BY cnt DESC, gram LIMIT 10000")
def ngram_counts(spark, sf_dir):
    return ngrams.top_grams(ngrams.gram_counts(table(spark, sf_dir, "documents"), "text"), 10_000)


GRAMS_5 = "SELECT unnest(list_transform(range(1, length(lower(text)) - 3), lambda i: substr(lower(text), i, 5))) AS gram FROM documents"


@query("ngram_counts_5", f"WITH g AS ({GRAMS_5}) SELECT gram, count(*) AS cnt FROM g GROUP BY gram ORDER BY cnt DESC, gram LIMIT 10000")
def ngram_counts_5(spark, sf_dir):
    return ngrams.most_frequent(table(spark, sf_dir, "documents"), "text", 10_000, 5)


DSIR = f"""
WITH g AS MATERIALIZED ({GRAMS}),
n AS (SELECT greatest(1, count(*) // 10) AS k, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS keep FROM documents),
first AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT k FROM n)),
s AS (SELECT gram, count(*) AS c FROM g GROUP BY gram ORDER BY c DESC, gram LIMIT 10000),
t AS (SELECT gram, count(*) AS c FROM g SEMI JOIN first USING (doc_id) GROUP BY gram ORDER BY c DESC, gram LIMIT 10000),
b AS (SELECT coalesce(s.gram, t.gram) AS gram, coalesce(s.c, 0) AS s, coalesce(t.c, 0) AS t FROM s FULL JOIN t ON s.gram = t.gram),
z AS (SELECT CAST(sum(s) AS DOUBLE) AS ts, CAST(sum(t) AS DOUBLE) AS tt, count(*) AS v FROM b),
r AS (SELECT gram, ln(greatest((t + ts * 0.01) / (tt + ts * 0.01 * v), 1e-10) / greatest((s + ts * 0.01) / (ts + ts * 0.01 * v), 1e-10)) AS log_ratio FROM b, z),
a AS (SELECT doc_id, avg(log_ratio) AS raw FROM g JOIN r USING (gram) GROUP BY doc_id),
w AS (SELECT d.doc_id, coalesce(raw, 0) AS raw FROM documents d LEFT JOIN a USING (doc_id)),
e AS (SELECT doc_id, CASE WHEN max(raw) OVER () > min(raw) OVER () THEN (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) ELSE 0 END AS weight FROM w)
"""


@query("dsir_log_ratio", DSIR + "SELECT gram, round(log_ratio, 6) AS log_ratio FROM r")
def dsir_log_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = sampling.first_rows(docs, max(1, docs.count() // 10), "doc_id")
    tops = [ngrams.top_grams(ngrams.gram_counts(x, "text"), 10_000) for x in (docs, first)]
    return ngrams.log_ratios(*tops).select("gram", F.round("log_ratio", 6).alias("log_ratio"))


@query("dsir_weights", DSIR + "SELECT doc_id, round(weight, 6) AS weight FROM e")
def dsir_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = sampling.first_rows(docs, max(1, docs.count() // 10), "doc_id")
    return ngrams.gram_weights(docs, first, "doc_id", "text").select("doc_id", F.round("weight", 6).alias("weight"))


@query("dsir_select", DSIR + "SELECT doc_id, round(weight, 6) AS weight FROM e ORDER BY e.weight DESC, doc_id DESC LIMIT (SELECT keep FROM n)")
def dsir_select(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select("doc_id", "text")
    return selectors.get_selector("dsir")(pool, "doc_id").select("doc_id", F.round("weight", 6).alias("weight"))


@query(
    "ordered_dedupe",
    """WITH r AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS roles FROM r""",
)
def ordered_dedupe(spark, sf_dir):
    """The roles of each conversation, each where it comes first."""
    return chats(spark, sf_dir).select("conv_id", tokens.distinct_in_order(F.col("messages.role")).alias("roles"))


CURATED = DSIR.replace("first AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT k FROM n))", "first AS (SELECT doc_id FROM labels WHERE quality = 1)")


@query("dsir_select_curated", CURATED + "SELECT doc_id, round(weight, 6) AS weight FROM e ORDER BY e.weight DESC, doc_id DESC LIMIT (SELECT keep FROM n)")
def dsir_select_curated(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = pool.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return selectors.get_selector("dsir")(pool, "doc_id", target=target).select("doc_id", F.round("weight", 6).alias("weight"))
