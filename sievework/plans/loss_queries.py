"""Queries over the losses of tokens: the chats' tokens, predicted where they are no prompt, by trigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records, tokens
from ..operators import evaluation, sampling, selectors, token_loss
from ..sources.tables import table, written
from .registry import query
from .sampling_queries import draws_sql, order
from .text_queries import IDS, TOKENS, normalize_sharegpt


def chat_tokens(spark, sf_dir):
    return tokens.tokenize(normalize_sharegpt(spark, sf_dir)).select("conv_id", "input_ids", "labels")


PLACES = f"""{TOKENS},
places AS MATERIALIZED (SELECT conv_id AS id, x[i] AS w, x[i - 1] AS c1, CASE WHEN i > 2 THEN x[i - 2] ELSE -1 END AS c2
  FROM (SELECT conv_id, input_ids AS x, masked, unnest(range(2, len(input_ids) + 1)) AS i FROM k) WHERE i > masked)"""


def model_sql(name: str, train: str, asked: str = "places") -> str:
    """Tables of a trigram model of the places in ``train``, and <name>_loss: id, loss of the places in ``asked``."""
    n = name
    return f"""{n}3 AS MATERIALIZED (SELECT c2, c1, w, count(*) AS n FROM ({train}) GROUP BY ALL), {n}2 AS MATERIALIZED (SELECT c1, w, sum(n) AS n FROM {n}3 GROUP BY ALL), {n}1 AS MATERIALIZED (SELECT w, sum(n) AS n FROM {n}2 GROUP BY ALL),
{n}x3 AS (SELECT c2, c1, sum(n) AS c, count(*) AS t FROM {n}3 GROUP BY ALL), {n}x2 AS (SELECT c1, sum(n) AS c, count(*) AS t FROM {n}2 GROUP BY ALL), {n}x1 AS (SELECT sum(n) AS c, count(*) AS t FROM {n}1),
{n}p1 AS (SELECT a.*, coalesce((coalesce(n, 0) + t * (1 / 32000.0::DOUBLE)) / (c + t), 1 / 32000.0::DOUBLE) AS p FROM {asked} a LEFT JOIN {n}1 USING (w), {n}x1),
{n}p2 AS (SELECT a.* REPLACE (coalesce((coalesce(n, 0) + t * p) / (c + t), p) AS p) FROM {n}p1 a LEFT JOIN {n}2 USING (c1, w) LEFT JOIN {n}x2 USING (c1)),
{n}p3 AS (SELECT a.* REPLACE (coalesce((coalesce(n, 0) + t * p) / (c + t), p) AS p) FROM {n}p2 a LEFT JOIN {n}3 USING (c2, c1, w) LEFT JOIN {n}x3 USING (c2, c1)),
{n}_loss AS MATERIALIZED (SELECT id, avg(-ln(p)) AS loss, count(*) AS tokens FROM {n}p3 GROUP BY id)"""


ALL = f"{PLACES}, {model_sql('a', 'SELECT * FROM places')}"


@query("token_loss", f"{ALL} SELECT conv_id, round(loss, 6) AS loss, coalesce(tokens, 0) AS tokens FROM k LEFT JOIN a_loss ON id = conv_id")
def token_loss_query(spark, sf_dir):
    """The mean loss of each chat's answer tokens under a model of all chats."""
    rows = written(chat_tokens(spark, sf_dir), "tokens")
    return token_loss.token_losses(rows, "conv_id", token_loss.fit(rows)).select("conv_id", F.round("loss", 6).alias("loss"), "tokens")


@query(
    "rho_token_select",
    f"""{ALL}, r AS (SELECT conv_id, row_number() OVER (ORDER BY {order('42', 'conv_id')}, conv_id) AS place, count(*) OVER () AS n FROM k),
h AS (SELECT conv_id FROM r WHERE place <= greatest(10, CAST(floor(n * 0.05) AS BIGINT))),
{model_sql('h', 'SELECT p.* FROM places p SEMI JOIN h ON p.id = h.conv_id')}
SELECT a_loss.id AS conv_id, round(a_loss.loss - h_loss.loss, 6) AS score FROM a_loss JOIN h_loss USING (id) WHERE id NOT IN (SELECT conv_id FROM h)
ORDER BY a_loss.loss - h_loss.loss DESC, conv_id DESC LIMIT (SELECT greatest(1, count(*) // 5) FROM k)""",
)
def rho_token_select(spark, sf_dir):
    """The chats whose answers a model of all chats finds harder than one of the holdout does, by most."""
    rows = written(chat_tokens(spark, sf_dir), "tokens")
    model = token_loss.fit(rows)
    found = selectors.get_selector("rho_loss")(rows, "conv_id", model=model)
    held = sampling.split_holdout(rows, "conv_id").where("holdout")
    both = [token_loss.token_losses(found, "conv_id", m).select("conv_id", F.col("loss").alias(x)) for m, x in ((model, "a"), (token_loss.fit(held), "h"))]
    return both[0].join(both[1], "conv_id").select("conv_id", F.round(F.col("a") - F.col("h"), 6).alias("score"))


STEPS = "e AS (SELECT id AS event_id, id // 16 AS step, loss FROM a_loss)"


@query("token_importance_batch", f"{ALL}, {draws_sql(STEPS)} SELECT event_id AS conv_id, step, round(p, 9) AS p, n, round(weight, 6) AS weight FROM b")
def token_importance_batch(spark, sf_dir):
    """Importance batches of the chats, sixteen of which are a step's candidates, by the losses of their answers."""
    rows = written(chat_tokens(spark, sf_dir), "tokens")
    losses = token_loss.token_losses(rows, "conv_id", token_loss.fit(rows)).where("loss is not null").withColumn("step", F.expr("conv_id div 16"))
    found = sampling.importance_batches(losses, "conv_id", "step", "loss", length=500)
    return found.select("conv_id", "step", F.round("p", 9).alias("p"), "n", F.round("weight", 6).alias("weight"))


WORDS = "string_split(text, ' ')"
ASKED = f"""
o AS (SELECT item_id, text, {WORDS}[-5:][1:4] AS c FROM benchmark),
q AS (SELECT item_id, 'Question: ' || text || chr(10) || chr(10) || array_to_string(list_transform(c, lambda x, i: substr('ABCD', i, 1) || '. ' || x || chr(10)), '') || chr(10) || 'Answer:' AS prompt, unnest(c) AS choice, generate_subscripts(c, 1) - 1 AS place FROM o),
y AS (SELECT item_id * 4 + place AS id, len({IDS.format('prompt')}) AS masked, {IDS.format("prompt || ' ' || choice")} AS x FROM q),
asked AS (SELECT id, x[i] AS w, x[i - 1] AS c1, CASE WHEN i > 2 THEN x[i - 2] ELSE -1 END AS c2 FROM (SELECT id, x, masked, unnest(range(2, len(x) + 1)) AS i FROM y) WHERE i > masked)"""


@query(
    "mmlu_token_loss",
    f"""{PLACES}, {ASKED}, {model_sql('m', 'SELECT * FROM places', 'asked')},
s AS (SELECT id // 4 AS item, arg_min(id % 4, (round(loss, 9), id)) AS best FROM m_loss GROUP BY id // 4)
SELECT CAST(item % 5 AS VARCHAR) AS subject, avg(CAST(best = item % 4 AS DOUBLE)) AS accuracy, count(*) AS total FROM s GROUP BY ROLLUP (CAST(item % 5 AS VARCHAR))""",
)
def mmlu_token_loss(spark, sf_dir):
    """Multiple choice as a language model answers it: of the choices the one whose words have the least loss after the prompt."""
    model = token_loss.fit(chat_tokens(spark, sf_dir))
    words = F.split("text", " ")
    last = F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), 5)
    asked = table(spark, sf_dir, "benchmark").select("item_id", records.choice_prompt(F.col("text"), last).alias("prompt"), F.posexplode(F.slice(last, 1, 4)).alias("place", "choice"))
    rows = tokens.tokenize(asked.select((F.col("item_id") * 4 + F.col("place")).alias("id"), "prompt", F.concat(F.lit(" "), "choice").alias("response")), max_length=1 << 20)
    losses = token_loss.token_losses(rows, "id", model).select(F.expr("id div 4").alias("item"), F.struct((F.col("id") % 4).alias("place"), F.round(-F.col("loss"), 9).alias("score")).alias("s"))
    scored = losses.groupBy("item").agg(F.array_sort(F.collect_list("s")).alias("s"))  # four of an item
    each = scored.select(F.transform("s", lambda x: x["score"]).alias("scores"), (F.col("item") % 4).alias("answer"), (F.col("item") % 5).cast("string").alias("subject"))
    return evaluation.choice_accuracy(each)
