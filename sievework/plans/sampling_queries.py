"""Queries over seeded samples, temperatures, importance batches and their variances. The stream of steps is the table of
events: a step is an hour, a loss is ln(1 + value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling, selectors
from ..operators.sampling import importance_weight, temperature
from ..sources import tables
from ..sources.tables import table
from .registry import query



def order(seed: str, *ids: str) -> str:
    return f"md5('{seed}:' || " + " || ':' || ".join(f"CAST({i} AS VARCHAR)" for i in ids) + ")"


def u(seed: str, *ids: str) -> str:
    return f"((CAST('0x' || substr({order(seed, *ids)}, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("subsample_hash", f"SELECT doc_id, n_chars FROM documents ORDER BY {order('42', 'doc_id')}, doc_id LIMIT 100")
def subsample_hash(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 100)


@query("uniform_select", f"SELECT doc_id, lang FROM documents ORDER BY {order('42', 'doc_id')}, doc_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM documents)")
def uniform_select(spark, sf_dir):
    return selectors.get_selector("uniform")(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("full_select", "SELECT doc_id, lang, source, n_chars FROM documents")
def full_select(spark, sf_dir):
    return selectors.get_selector("full")(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


HOLDOUT = f"""
r AS (SELECT vec_id, label, row_number() OVER (ORDER BY {order('42', 'vec_id')}, vec_id) AS k, count(*) OVER () AS n FROM embeddings),
h AS (SELECT vec_id, label, k <= greatest(10, CAST(floor(n * 0.05) AS BIGINT)) AS holdout FROM r)"""


@query("holdout_split", f"WITH {HOLDOUT} SELECT vec_id, label, holdout FROM h")
def holdout_split(spark, sf_dir):
    return sampling.split_holdout(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "label", "holdout")


@query(
    "anti_join_candidates",
    f"SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY {order('7', 'doc_id')}, doc_id LIMIT 256",
)
def anti_join_candidates(spark, sf_dir):
    docs, toxic = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1")
    return sampling.candidates(docs, "doc_id", 64, 4, 7, toxic)


@query("weighted_sample", f"SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 ORDER BY -ln({u('42', 'doc_id')}) / n_chars, doc_id LIMIT 100")
def weighted_sample(spark, sf_dir):
    return sampling.weighted_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100)


RESAMPLE = f"""
WITH r AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS w, CAST('0x' || substr({order('bucket', 'doc_id')}, 1, 7) AS BIGINT) % 64 AS bucket FROM documents WHERE n_chars > 0),
l AS (SELECT doc_id, sum(w) OVER (ORDER BY bucket, doc_id ROWS UNBOUNDED PRECEDING) AS hi, w, sum(w) OVER () AS total FROM r),
d AS (SELECT range AS draw FROM range(500)),
p AS (SELECT draw, {u('42', 'draw')} * (SELECT max(total) FROM l) AS pt FROM d)
SELECT draw, doc_id FROM p JOIN l ON pt >= hi - w AND pt < hi"""


@query("weighted_resample", RESAMPLE)
def weighted_resample(spark, sf_dir):
    return sampling.resample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 500)


STEPS = """
e AS (SELECT event_id, event_type, CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) - (SELECT CAST(epoch(min(date_trunc('hour', ts))) // 3600 AS BIGINT) FROM events) AS step,
  ln(1 + value) AS loss FROM events)"""


def losses(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hour = F.expr("unix_timestamp(date_trunc('HOUR', ts)) div 3600")
    first = events.agg(F.min(hour).alias("first"))
    from ..operators.scalars import beside

    return beside(events.select("event_id", "event_type", hour.alias("h"), F.ln(1 + F.col("value")).alias("loss")), first).select(
        "event_id", "event_type", (F.col("h") - F.col("first")).alias("step"), "loss"
    )


def tau(strategy: str) -> str:
    now = {"linear": "1.0 + (0.1 - 1.0) * (step / 500.0)", "cosine": "0.1 + 0.5 * (1.0 - 0.1) * (1 + cos(3.141592653589793 * (step / 500.0)))"}
    return "CAST(1 AS DOUBLE)" if strategy == "constant" else f"CASE WHEN step >= 500 THEN 0.1 ELSE {now[strategy]} END"


@query("tau_schedule", f"WITH {STEPS}, s AS (SELECT DISTINCT step FROM e) SELECT step, " + ", ".join(f"round({tau(s)}, 9) AS tau_{s}" for s in sampling.STRATEGIES) + " FROM s")
def tau_schedule(spark, sf_dir):
    steps = losses(spark, sf_dir).select("step").distinct()
    return steps.select("step", *[F.round(temperature(F.col("step"), s, length=500), 9).alias(f"tau_{s}") for s in sampling.STRATEGIES])


SOFTMAX = f"""
{STEPS}, z AS (SELECT *, loss / ({tau('linear')}) AS z FROM e),
x AS (SELECT *, exp(z - max(z) OVER (PARTITION BY step)) AS ex, count(*) OVER (PARTITION BY step) AS n FROM z),
p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY step) AS p FROM x)"""


@query("softmax_probs", f"WITH {SOFTMAX} SELECT event_id, step, round(p, 9) AS p FROM p")
def softmax_probs(spark, sf_dir):
    rows = losses(spark, sf_dir).withColumn("tau", temperature(F.col("step"), length=500))
    return sampling.softmax(rows, "loss", "tau", "step").select("event_id", "step", F.round("p", 9).alias("p"))


@query("importance_weights", f"WITH {SOFTMAX} SELECT event_id, step, round(least(1 / (p * n), 10), 6) AS weight FROM p")
def importance_weights(spark, sf_dir):
    rows = losses(spark, sf_dir).withColumn("tau", temperature(F.col("step"), length=500))
    return sampling.softmax(rows, "loss", "tau", "step").select("event_id", "step", F.round(importance_weight(F.col("p"), F.col("n")), 6).alias("weight"))


def draws_sql(steps: str) -> str:
    """Tables up to b, the importance batches of the table e (event_id, step, loss) that ``steps`` defines."""
    return f"""
{steps}, c AS (SELECT *, {tau('linear')} AS tau, row_number() OVER (PARTITION BY step ORDER BY {order('42', 'event_id', 'step')}, event_id) AS k FROM e),
z AS (SELECT *, loss / tau AS z FROM c WHERE k <= 16),
x AS (SELECT *, exp(z - max(z) OVER (PARTITION BY step)) AS ex, count(*) OVER (PARTITION BY step) AS n FROM z),
p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY step) AS p FROM x),
d AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY -ln({u('draw42', 'event_id', 'step')}) / greatest(p, 1e-300), event_id) AS place FROM p),
b AS (SELECT event_id, step, loss, tau, p, n, least(1 / (p * n), 10) AS weight FROM d WHERE place <= 4)"""


BATCH = draws_sql(STEPS)


def batches(spark, sf_dir):
    return sampling.importance_batches(losses(spark, sf_dir), "event_id", "step", "loss", length=500)


@query("importance_batch", f"WITH {BATCH} SELECT event_id, step, round(p, 9) AS p, n, round(weight, 6) AS weight FROM b")
def importance_batch(spark, sf_dir):
    return batches(spark, sf_dir).select("event_id", "step", F.round("p", 9).alias("p"), "n", F.round("weight", 6).alias("weight"))


@query("uniform_fallback", f"WITH {STEPS}, c AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY {order('42', 'event_id', 'step')}, event_id) AS k FROM e) SELECT event_id, step, 1.0::DOUBLE AS weight FROM c WHERE k <= 4")
def uniform_fallback(spark, sf_dir):
    return sampling.uniform_batches(losses(spark, sf_dir), "event_id", "step")


@query("weighted_batch_loss", f"WITH {BATCH} SELECT step, round(avg(loss) * avg(weight), 6) AS batch_weighted, round(avg(loss * weight), 6) AS sample_weighted FROM b GROUP BY step")
def weighted_batch_loss(spark, sf_dir):
    found = sampling.weighted_loss(batches(spark, sf_dir), "step", "loss", "weight")
    return found.select("step", F.round("batch_weighted", 6).alias("batch_weighted"), F.round("sample_weighted", 6).alias("sample_weighted"))


@query("batch_stats", f"WITH {BATCH} SELECT round(avg(tau), 6) AS mean_tau, round(avg(loss), 6) AS mean_loss, count(*) AS rows FROM b")
def batch_stats(spark, sf_dir):
    return batches(spark, sf_dir).agg(F.round(F.avg("tau"), 6).alias("mean_tau"), F.round(F.avg("loss"), 6).alias("mean_loss"), F.count(F.lit(1)).alias("rows"))


ETA = f"""
{BATCH}, v AS (SELECT step, var_samp(loss / (p + 1e-8)) AS imp, var_samp(loss) AS uni, var_samp(loss / ((p + 1e-8) * n)) AS scaled FROM b GROUP BY step),
t AS (SELECT step, 1 - imp / uni AS eta, 1 - scaled / uni AS scaled_eta FROM v WHERE uni > 0 AND imp IS NOT NULL)"""


@query("variance_eta", f"WITH {ETA} SELECT step, round(ln(1 - eta), 6) AS log_ratio, round(ln(1 - scaled_eta), 6) AS scaled_log_ratio FROM t")
def variance_eta(spark, sf_dir):
    """As the logarithm of 1 - eta, for a candidate of tiny probability makes eta very large."""
    found = batches(spark, sf_dir)
    plain, scaled = sampling.variance_reduction(found, "step", "loss", "p"), sampling.variance_reduction(found, "step", "loss", "p", "n")
    both = plain.join(scaled.withColumnRenamed("eta", "scaled_eta"), "step")
    return both.select("step", F.round(F.ln(1 - F.col("eta")), 6).alias("log_ratio"), F.round(F.ln(1 - F.col("scaled_eta")), 6).alias("scaled_log_ratio"))


@query(
    "step_stats",
    f"""WITH {ETA}, a AS (SELECT step, max(tau) AS tau, max(n) AS candidates, count(*) AS rows, avg(loss) AS mean_loss, avg(weight) AS mean_weight FROM b GROUP BY step)
SELECT step, round(tau, 9) AS tau, candidates, rows, round(mean_loss, 6) AS mean_loss, round(mean_weight, 6) AS mean_weight, round(ln(1 - eta), 6) AS log_ratio FROM a LEFT JOIN t USING (step)""",
)
def step_stats(spark, sf_dir):
    """The figures of each step's batch; of the variance saved the logarithm of 1 - eta."""
    found = sampling.step_stats(batches(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_loss", "mean_weight")]
    return found.select("step", F.round("tau", 9).alias("tau"), "candidates", "rows", *rounded, F.round(F.ln(1 - F.col("eta")), 6).alias("log_ratio"))


GUARD = f"""
WITH RECURSIVE {ETA.strip()},
o AS MATERIALIZED (SELECT step, eta, row_number() OVER (ORDER BY step) AS k FROM t),
f AS (SELECT step, k, eta AS ema FROM o WHERE k = 1 UNION ALL SELECT o.step, o.k, 0.95 * f.ema + (1 - 0.95) * o.eta FROM f JOIN o ON o.k = f.k + 1),
g AS (SELECT min(step) AS first FROM f WHERE ema < {{threshold}}),
q AS (SELECT event_id, step, n, CASE WHEN step > (SELECT first FROM g) THEN 1.0 / n ELSE p END AS p, coalesce(step > (SELECT first FROM g), false) AS flat FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY -ln({u('draw42', 'event_id', 'step')}) / greatest(p, 1e-300), event_id) AS place FROM q)
SELECT event_id, step, round(p, 9) AS p, round(CASE WHEN flat THEN 1.0 ELSE least(1 / (p * n), 10) END, 6) AS weight FROM s WHERE place <= 4"""


@query("guarded_batches", GUARD.replace("{threshold}", "-1e6"))
def guarded_batches(spark, sf_dir):
    """Importance batches, and uniform ones once the moving average of the variance that they save is below the threshold."""
    found = sampling.guarded_batches(losses(spark, sf_dir), "event_id", "step", "loss", threshold=-1e6, length=500)
    return found.select("event_id", "step", F.round("p", 9).alias("p"), F.round("weight", 6).alias("weight"))


@query("pool_reshuffle", f"SELECT doc_id, lang FROM documents ORDER BY {order('44', 'doc_id')}, doc_id LIMIT 100")
def pool_reshuffle(spark, sf_dir):
    """The first rows of the pool as it is shuffled for the second round."""
    return sampling.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, sampling.round_seed(42, 2))


@query("pool_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def pool_lookup(spark, sf_dir):
    return sampling.rows_of(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels").where("toxic = 1"))


@query("pool_split", f"SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY {order('42', 'doc_id')}, doc_id LIMIT 50")
def pool_split(spark, sf_dir):
    """A pool written with a split for each language; some rows of one split."""
    path = tables.scratch(spark, "pool")
    table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("split")).write.partitionBy("split").parquet(path)
    return tables.read_pool(spark, path, "en", 50, id_col="doc_id").select("doc_id", "n_chars")


@query(
    "validation_sets",
    f"""(SELECT 'benchmark' AS dim, item_id AS sample_id, text FROM benchmark ORDER BY {order('42', 'item_id')}, item_id LIMIT 30)
UNION ALL (SELECT 'good', doc_id, text FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) ORDER BY {order('42', 'doc_id')}, doc_id LIMIT 30)""",
)
def validation_sets(spark, sf_dir):
    """The catalog of two validation sets and an empty one."""
    good = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select(F.col("doc_id").alias("sample_id"), "text")
    marks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample_id"), "text")
    return tables.validation_catalog({"benchmark": marks, "good": good, "none": good.limit(0)}, 30).select("dim", "sample_id", "text")


EMA = """
WITH RECURSIVE o AS (SELECT event_type, event_id, ln(1 + value) AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_type, k, x AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.event_type, o.k, 0.95 * f.ema + (1 - 0.95) * o.x FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)
SELECT event_type, round(arg_max(ema, k), 6) AS ema, max(k) AS steps, arg_max(ema, k) < 1.5 AS use_uniform FROM f GROUP BY event_type"""


@query("variance_ema", EMA)
def variance_ema(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.struct("ts", "event_id").alias("at"), F.ln(1 + F.col("value")).alias("x"))
    found = sampling.ema(events, "event_type", "at", "x", threshold=1.5)
    return found.select("event_type", F.round("ema", 6).alias("ema"), "steps", "use_uniform")


@query("weights_with_default", "SELECT d.doc_id, CAST(coalesce(1.0 + l.quality, 1.0) AS DOUBLE) AS weight FROM documents d LEFT JOIN labels l USING (doc_id)")
def weights_with_default(spark, sf_dir):
    weights = table(spark, sf_dir, "labels").select("doc_id", (1.0 + F.col("quality")).cast("double").alias("weight"))
    return sampling.with_weights(table(spark, sf_dir, "documents").select("doc_id"), weights, "doc_id")
