"""Queries over benchmarks' prompts and answers, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import evaluation
from ..sources import tables
from ..sources.tables import scratch, table
from ..streaming import averages, batches
from .influence_queries import MODEL, checkpoints, samples
from .registry import query
from .sampling_queries import EMA, GUARD, losses

WORDS = "string_split(text, ' ')"


@query(
    "mmlu_prompt",
    f"""WITH w AS (SELECT item_id, text, {WORDS} AS w FROM benchmark), c AS (SELECT item_id, text AS q, w[-5:][1:4] AS c FROM w)
SELECT item_id, 'Question: ' || q || chr(10) || chr(10) || array_to_string(list_transform(c, lambda x, i: substr('ABCD', i, 1) || '. ' || x || chr(10)), '') || chr(10) || 'Answer:' AS prompt FROM c""",
)
def mmlu_prompt(spark, sf_dir):
    """The whole text is the question, and its last words are the choices."""
    words = F.split("text", " ")
    last = F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), 5)
    return table(spark, sf_dir, "benchmark").select("item_id", records.choice_prompt(F.col("text"), last).alias("prompt"))


@query(
    "gsm8k_prompt",
    f"""SELECT item_id, '{records.STEP_BY_STEP.replace("'", "''").rstrip()}' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Let''s solve this step by step:' || chr(10) AS cot,
  'Question: ' || text || chr(10) || 'Answer:' AS plain FROM benchmark""",
)
def gsm8k_prompt(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", records.math_prompt(F.col("text")).alias("cot"), records.math_prompt(F.col("text"), False).alias("plain"))


NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
SAID = "CASE WHEN doc_id % 3 = 0 THEN text || ' #### ' || format('{:,}', n_chars) || ' or 7' ELSE text END"
FINAL = rf"TRY_CAST(replace(coalesce(nullif(regexp_extract(said, '####\s*({NUMBER})', 1), ''), regexp_extract_all(said, '{NUMBER}')[-1]), ',', '') AS DOUBLE)"


def answers(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" #### "), F.format_number("n_chars", 0), F.lit(" or 7"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("said"), F.col("n_chars").cast("string").alias("truth"))


@query("gsm8k_extract", f"WITH a AS (SELECT doc_id, {SAID} AS said FROM documents) SELECT doc_id, {FINAL} AS number FROM a")
def gsm8k_extract(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", records.final_number(F.col("said")).alias("number"))


@query(
    "gsm8k_accuracy",
    f"WITH a AS (SELECT n_chars, {SAID} AS said FROM documents), r AS (SELECT coalesce(abs({FINAL} - n_chars) < 1e-6, false) AS r FROM a) SELECT count(*) FILTER (WHERE r) / count(*) AS accuracy, count(*) FILTER (WHERE r) AS correct, count(*) AS total FROM r",
)
def gsm8k_accuracy(spark, sf_dir):
    return evaluation.number_accuracy(answers(spark, sf_dir))


@query(
    "mmlu_subject_accuracy",
    f"""WITH {MODEL}, b AS (SELECT vec_id, label, arg_max(cls, (round(dot, 9), -cls)) AS best FROM d GROUP BY vec_id, label)
SELECT CAST(vec_id % 5 AS VARCHAR) AS subject, avg(CAST(best = label AS DOUBLE)) AS accuracy, count(*) AS total FROM b GROUP BY ROLLUP (CAST(vec_id % 5 AS VARCHAR))""",
)
def mmlu_subject_accuracy(spark, sf_dir):
    """The classes are the choices, and a vector's inner products with their means the scores."""
    x = samples(spark, sf_dir)
    means = checkpoints(x)[0].params / 4
    each = [F.round(F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in m]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v), 9) for m in means]
    scored = x.select(F.array(*each).alias("scores"), F.col("label").alias("answer"), (F.col("vec_id") % 5).cast("string").alias("subject"))
    return evaluation.choice_accuracy(scored)


@query(
    "evaluation_runner",
    f"""WITH a AS (SELECT n_chars, {SAID} AS said FROM documents), r AS (SELECT coalesce(abs({FINAL} - n_chars) < 1e-6, false) AS r FROM a)
SELECT 'gsm8k' AS benchmark, count(*) FILTER (WHERE r) / count(*) AS accuracy, '' AS note FROM r
UNION ALL VALUES {", ".join(f"('{k}', 0.0, '{v}')" for k, v in evaluation.NEED_A_MODEL.items())}""",
)
def evaluation_runner(spark, sf_dir):
    return evaluation.evaluate(spark, ["gsm8k", "humaneval", "mt_bench", "alpaca_eval", "no_such"], {"gsm8k": lambda: gsm8k_accuracy(spark, sf_dir)})


def event_stream(spark, sf_dir):
    """The rows of events.parquet, a file or a folder of files, and how many there are."""
    path = f"{sf_dir}/events.parquet"
    whole = spark.read.parquet(path)
    reader = spark.readStream.schema(whole.schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream reads folders only
    else:
        stream = reader.parquet(path)
    return stream.withColumns({"loss": F.ln(1 + F.col("value")), "ts": F.col("ts").cast("timestamp")}), whole.count()


@query("streaming_ema", EMA)
def streaming_ema(spark, sf_dir):
    """The moving averages at the end of the stream of events."""
    out, (stream, n) = scratch(spark, "ema"), event_stream(spark, sf_dir)
    averages.fold_averages(stream, "event_type", "ts", "loss", "event_id", out, scratch(spark, "state"), forget="1000 days", rows=n)
    return averages.averages(spark, out, 1.5).select(F.col("key").alias("event_type"), F.round("ema", 6).alias("ema"), "steps", "use_uniform")


@query("streaming_batches", GUARD.replace("{threshold}", "-1e6"))
def streaming_batches(spark, sf_dir):
    """guarded_batches on a stream: the events arrive in four parts in the order of time, and the stream is stopped after each and taken up again."""
    spark, out, state, source = batches.session(spark), scratch(spark, "batches"), scratch(spark, "state"), scratch(spark, "source")
    rows = losses(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id")
    ends = rows.agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    part = F.least(F.lit(3), F.floor((F.unix_micros("ts") - ends["low"]) * 4 / max(1, ends["high"] - ends["low"])))
    steps = batches.Steps("event_id", "step", "loss", "ts", F.date_trunc("HOUR", "ts") + F.expr("INTERVAL 1 HOUR"), threshold=-1e6, how={"length": 500})
    for k in range(4):
        rows.where(part == k).write.mode("append").parquet(source)
        batches.run(spark.readStream.schema(rows.schema).parquet(source), steps, out, state)
    batches.finish(spark, steps, out, state)
    return batches.batches(spark, out).select("event_id", "step", F.round("p", 9).alias("p"), F.round("weight", 6).alias("weight"))


@query(
    "streaming_windows",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS key, count(*) AS n, round(avg(ln(1 + value)), 6) AS mean, round(var_samp(ln(1 + value)), 6) AS var
FROM events GROUP BY ALL""",
)
def streaming_windows(spark, sf_dir):
    """Hourly losses of each event type, with the windows that are open when the stream ends."""
    out, (stream, n) = scratch(spark, "windows"), event_stream(spark, sf_dir)
    averages.run_to_table(averages.windowed(stream, "ts", "event_type", "loss"), out, scratch(spark, "state"), rows=n)
    last = averages.last_states(spark, out, "start timestamp, key string, n long, mean double, var double", ["start", "key"])
    return last.select("start", "key", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(
    "result_sink",
    f"""WITH a AS (SELECT n_chars, {SAID} AS said FROM documents), r AS (SELECT coalesce(abs({FINAL} - n_chars) < 1e-6, false) AS r FROM a)
SELECT 'gsm8k' AS benchmark, count(*) FILTER (WHERE r) / count(*) AS accuracy FROM r UNION ALL SELECT 'humaneval', 0.0""",
)
def result_sink(spark, sf_dir):
    """Results written as JSON lines and read again."""
    path = scratch(spark, "results")
    tables.write_results(evaluation.evaluate(spark, ["gsm8k", "humaneval"], {"gsm8k": lambda: gsm8k_accuracy(spark, sf_dir)}), path)
    return spark.read.schema("benchmark string, accuracy double").json(path)
