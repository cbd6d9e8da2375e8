"""Queries over scores by gradients. The model is a softmax regression on the embeddings; its checkpoints 1, 2 and 3 have 4, 8 and
12 times the mean vector of each class as weights. An eighth of the vectors, by hash, validates four dimensions: label % 4."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import clusters, influence, phases, quantiles, selectors
from ..operators.influence import Checkpoint, SoftmaxScorer
from ..operators.sampling import shuffle_key
from ..sources import tables
from ..sources.tables import table
from .registry import query
from .sampling_queries import order

DIMS = ("reasoning", "safety", "chat", "factual")
LAMBDAS = {"reasoning": 0.30, "safety": 0.25, "chat": 0.25, "factual": 0.20}
#: Columns of a gradient in a block: fewer than the vectors have.
WIDTH = 24
NAMES = "['" + "', '".join(DIMS) + "']"


def samples(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def checkpoints(df) -> list[Checkpoint]:
    """The model's parameters: as many numbers as classes times components."""
    x = df.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("w")).collect()
    means = np.zeros((max(r["label"] for r in rows) + 1, len(rows[0]["w"])))
    for r in rows:
        means[r["label"]] = r["w"]
    return [Checkpoint(k, 1e-3 * k, 4 * k * means) for k in (1, 2, 3)]


def is_validation():
    return F.substring(shuffle_key(42, "vec_id"), 1, 1).isin("0", "1")


def dim():
    return F.element_at(F.array(*map(F.lit, DIMS)), (F.col("label") % 4 + 1).cast("int"))


MODEL = """
x AS MATERIALIZED (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS MATERIALIZED (SELECT label AS cls, i, avg(v) AS w FROM x GROUP BY ALL),
n AS (SELECT vec_id, sum(v * v) AS xx FROM x GROUP BY vec_id),
d AS MATERIALIZED (SELECT vec_id, label, cls, sum(v * w) AS dot FROM x JOIN m USING (i) GROUP BY ALL),
z AS (SELECT *, 4 * step * dot AS z FROM d, (VALUES (1), (2), (3)) k(step)),
e AS (SELECT *, exp(z - max(z) OVER g) AS ex FROM z WINDOW g AS (PARTITION BY vec_id, step)),
p AS MATERIALIZED (SELECT vec_id, label, cls, step, ex / sum(ex) OVER (PARTITION BY vec_id, step) AS p, ex / sum(ex) OVER (PARTITION BY vec_id, step) - CAST(cls = label AS INTEGER) AS r FROM e),
g AS MATERIALIZED (SELECT vec_id, label, step, sum(r * r) * any_value(xx) AS norm2, -ln(max(CASE WHEN cls = label THEN p END)) AS loss FROM p JOIN n USING (vec_id) GROUP BY vec_id, label, step),
si AS MATERIALIZED (SELECT vec_id, sum(norm2) / 3 AS score FROM g GROUP BY vec_id)"""


def vector_sql(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda q: CAST(q[1] AS DOUBLE) * CAST(q[2] AS DOUBLE)))"


@query(
    "vec_dot_cosine_norm",
    f"""WITH f AS (SELECT embedding AS b FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round({vector_sql('embedding', 'b')}, 6) AS dot, round({vector_sql('embedding', 'b')} / (sqrt({vector_sql('embedding', 'embedding')}) * sqrt({vector_sql('b', 'b')})), 6) AS cosine,
  round(sqrt({vector_sql('embedding', 'embedding')}), 6) AS norm FROM embeddings, f""",
)
def vec_dot_cosine_norm(spark, sf_dir):
    from ..operators.scalars import beside

    x = samples(spark, sf_dir)
    both = beside(x, x.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b")))
    a, b = F.col("embedding"), F.col("b")
    return both.select("vec_id", F.round(vectors.dot(a, b), 6).alias("dot"), F.round(vectors.cosine(a, b), 6).alias("cosine"), F.round(vectors.norm(a), 6).alias("norm"))


LESS = f"""
WITH x AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
l AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) AS l FROM x GROUP BY vec_id),
un AS MATERIALIZED (SELECT vec_id, i, v / l AS v FROM x JOIN l USING (vec_id)),
c AS (SELECT count(*) AS n FROM embeddings),
pr AS (SELECT vec_id FROM embeddings ORDER BY {order('42', 'vec_id')}, vec_id LIMIT (SELECT least(100, n // 10) FROM c)),
mu AS (SELECT i, avg(v) AS w FROM un SEMI JOIN pr USING (vec_id) GROUP BY i),
s AS (SELECT vec_id, sum(v * w) AS score FROM un JOIN mu USING (i) GROUP BY vec_id)"""


@query("less_scores", LESS + "SELECT vec_id, round(score, 6) AS score FROM s")
def less_scores(spark, sf_dir):
    x = samples(spark, sf_dir)
    return selectors.proxy_scores(x, "vec_id", "embedding", selectors.proxy_rows(x, "vec_id")).select("vec_id", F.round("score", 6).alias("score"))


@query("less_select", LESS + "SELECT vec_id, label FROM s JOIN embeddings USING (vec_id) ORDER BY score DESC, vec_id DESC LIMIT (SELECT greatest(1, n // 5) FROM c)")
def less_select(spark, sf_dir):
    return selectors.get_selector("less")(samples(spark, sf_dir), "vec_id").select("vec_id", "label")


def losses(spark, sf_dir):
    x = samples(spark, sf_dir)
    return influence.gradient_norms(x, "vec_id", SoftmaxScorer(), checkpoints(x)[-1:]).select("vec_id", "loss")


@query(
    "rho_loss_select",
    f"""WITH {MODEL}, r AS (SELECT vec_id, row_number() OVER (ORDER BY {order('42', 'vec_id')}, vec_id) AS k, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, round(loss, 6) AS loss FROM g JOIN r USING (vec_id) WHERE step = 3 AND k > greatest(10, CAST(floor(n * 0.05) AS BIGINT))
ORDER BY g.loss DESC, vec_id DESC LIMIT (SELECT greatest(1, count(*) // 5) FROM embeddings)""",
)
def rho_loss_select(spark, sf_dir):
    found = losses(spark, sf_dir)
    return selectors.get_selector("rho_loss")(samples(spark, sf_dir), "vec_id", found).join(found, "vec_id").select("vec_id", F.round("loss", 6).alias("loss"))


def scores(spark, sf_dir):
    x = samples(spark, sf_dir)
    return influence.self_influence(x, "vec_id", SoftmaxScorer(), checkpoints(x))


@query("self_influence", f"WITH {MODEL} SELECT vec_id, round(score, 6) AS score FROM si")
def self_influence(spark, sf_dir):
    return scores(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "score_stats",
    f"""WITH {MODEL} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max,
  avg(CAST(score > 0 AS DOUBLE)) AS positive, avg(CAST(score < 0 AS DOUBLE)) AS negative FROM si""",
)
def score_stats(spark, sf_dir):
    s = influence.summary(scores(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], "positive", "negative")


CUT = f"{MODEL}, o AS MATERIALIZED (SELECT vec_id, score, round(score, 9) >= round((SELECT quantile_cont(score, 0.95) FROM si), 9) AS is_outlier FROM si)"


SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("score_percentiles", f"WITH {MODEL} SELECT unnest([{', '.join(map(str, SHARES))}]::DOUBLE[]) AS share, round(unnest(quantile_cont(score, [{', '.join(map(str, SHARES))}])), 9) AS value FROM si")
def score_percentiles(spark, sf_dir):
    found = quantiles.percentiles(tables.written(scores(spark, sf_dir), "scores"), "score", SHARES)
    values = spark.createDataFrame([(s, v) for s, v in zip(SHARES, found, strict=True)], "share double, value double")
    return values.select("share", F.round("value", 9).alias("value"))


@query("outlier_flag", f"WITH {CUT} SELECT vec_id, is_outlier FROM o")
def outlier_flag(spark, sf_dir):
    return selectors.outliers(scores(spark, sf_dir)).select("vec_id", "is_outlier")


@query(
    "phase1_min_max_guard",
    f"""WITH {CUT}, l AS (SELECT *, CASE WHEN is_outlier THEN 'outlier' WHEN vec_id % 7 = 0 THEN 'representative' ELSE 'redundant' END AS label FROM o),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 'representative') AS good FROM l)
SELECT vec_id, label FROM l WHERE CASE WHEN (SELECT good FROM c) >= 5000 THEN label = 'representative' ELSE label <> 'outlier' END
ORDER BY score, vec_id LIMIT (SELECT greatest(100, n // 5) FROM c)""",
)
def phase1_min_max_guard(spark, sf_dir):
    label = F.when(F.col("is_outlier"), "outlier").when(F.col("vec_id") % 7 == 0, "representative").otherwise("redundant")
    return selectors.kept_rows(selectors.outliers(scores(spark, sf_dir)).withColumn("label", label), "vec_id").select("vec_id", "label")


@query(
    "phase1_select",
    f"""WITH {CUT} SELECT vec_id, embeddings.label, round(score, 6) AS influence_score, 'representative' AS p1_label FROM o JOIN embeddings USING (vec_id)
WHERE NOT is_outlier ORDER BY o.score, vec_id LIMIT (SELECT greatest(100, count(*) // 5) FROM embeddings)""",
)
def phase1_select(spark, sf_dir):
    found = selectors.get_selector("tracin_cp")(samples(spark, sf_dir), "vec_id", scores(spark, sf_dir))
    return found.select("vec_id", "label", F.round("influence_score", 6).alias("influence_score"), "p1_label")


@query("phase1_select_kmeans")
def phase1_select_kmeans(spark, sf_dir):
    found = selectors.get_selector("tracin_cp")(samples(spark, sf_dir), "vec_id", scores(spark, sf_dir), method="kmeans")
    return found.select("vec_id", "influence_score", "p1_label")


@query(
    "cluster_representatives",
    f"""WITH {MODEL}, c AS (SELECT vec_id, label, round(1 - sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))), 9) AS distance FROM x JOIN m ON m.cls = x.label AND m.i = x.i GROUP BY vec_id, label)
SELECT label AS cluster, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS k FROM c) WHERE k = 1""",
)
def cluster_representatives(spark, sf_dir):
    x = samples(spark, sf_dir).withColumnRenamed("label", "cluster")
    parts = x.select("cluster", F.posexplode("embedding").alias("i", "v")).groupBy("cluster", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centers = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda v: v["v"]).alias("center"))
    return clusters.representatives(x.join(centers, "cluster"), "vec_id", "embedding").select("cluster", "vec_id", F.round("distance", 6).alias("distance"))


@query("agglomerative_clusters")
def agglomerative_clusters(spark, sf_dir):
    x = samples(spark, sf_dir).drop("label")
    k = clusters.default_clusters(x.count())
    return clusters.representatives(clusters.fit_clusters(x, "embedding", k, "agglomerative"), "vec_id", "embedding").select("cluster", "vec_id", "distance")


@query(
    "similar_pairs",
    f"""WITH e AS (SELECT vec_id, embedding, sqrt({vector_sql('embedding', 'embedding')}) AS l FROM embeddings)
SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {vector_sql('a.embedding', 'b.embedding')} / (a.l * b.l) >= 0.45""",
)
def similar_pairs(spark, sf_dir):
    return clusters.similar_pairs(samples(spark, sf_dir), "vec_id", "embedding", 0.45)


@query(
    "greedy_dedup",
    f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding, sqrt({vector_sql('embedding', 'embedding')}) AS l FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {vector_sql('a.embedding', 'b.embedding')} / (a.l * b.l) >= 0.45),
o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM e),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept
  UNION ALL SELECT o.k, CASE WHEN len(list_intersect(r.kept, coalesce((SELECT list(i) FROM p WHERE p.j = o.vec_id), CAST([] AS BIGINT[])))) > 0 THEN r.kept ELSE list_append(r.kept, o.vec_id) END
  FROM r JOIN o ON o.k = r.k + 1)
SELECT vec_id, label FROM e WHERE vec_id IN (SELECT unnest(arg_max(kept, k)) FROM r)""",
)
def greedy_dedup(spark, sf_dir):
    x = samples(spark, sf_dir)
    return x.join(clusters.greedy_redundant(x, "vec_id", "embedding", 0.45), "vec_id", "left_anti").select("vec_id", "label")


VALID = f"""{MODEL}, va AS (SELECT vec_id FROM embeddings WHERE substr({order('42', 'vec_id')}, 1, 1) IN ('0', '1')),
gr AS MATERIALIZED (SELECT step, ({NAMES})[p.label % 4 + 1] AS dim, cls, i, avg(r * v) AS g FROM p SEMI JOIN va USING (vec_id) JOIN x USING (vec_id) GROUP BY ALL)"""


@query("val_mean_gradient", f"WITH {VALID} SELECT CAST(step AS BIGINT) AS step, dim, count(*) AS size, round(sqrt(sum(g * g)), 6) AS norm FROM gr GROUP BY ALL")
def val_mean_gradient(spark, sf_dir):
    x = samples(spark, sf_dir)
    found = influence.mean_gradients(x.where(is_validation()).withColumn("dim", dim()), "dim", SoftmaxScorer(), checkpoints(x), WIDTH)
    return influence.gradient_norms_of(found).select("step", "dim", "size", F.round("norm", 6).alias("norm"))


def influences(spark, sf_dir):
    x = samples(spark, sf_dir)
    points = checkpoints(x)
    gradients = influence.mean_gradients(x.where(is_validation()).withColumn("dim", dim()), "dim", SoftmaxScorer(), points, WIDTH)
    return influence.validation_influence(x, "vec_id", SoftmaxScorer(), points, gradients)


INFLUENCE = f"""{VALID}, gn AS (SELECT step, dim, sqrt(sum(g * g)) AS gn FROM gr GROUP BY ALL),
gx AS (SELECT step, dim, cls, vec_id, sum(g * v) AS gx FROM gr JOIN x USING (i) GROUP BY ALL),
ip AS (SELECT step, dim, vec_id, sum(r * gx) AS inner_ FROM gx JOIN p USING (step, cls, vec_id) GROUP BY ALL),
vi AS MATERIALIZED (SELECT vec_id, dim, sum(inner_ / (greatest(sqrt(norm2), 1e-12) * greatest(gn, 1e-12))) / 3 AS score FROM ip JOIN gn USING (step, dim) JOIN g USING (step, vec_id) GROUP BY vec_id, dim)"""


@query("validation_influence", f"WITH {INFLUENCE} SELECT vec_id, dim, round(score, 6) AS score FROM vi")
def validation_influence(spark, sf_dir):
    return influences(spark, sf_dir).select("vec_id", "dim", F.round("score", 6).alias("score"))


TOTAL = f"""{INFLUENCE}, la AS (SELECT vec_id, {", ".join(f"max(CASE WHEN dim = '{d}' THEN score END) AS {d}_score" for d in DIMS)},
  sum(score * CASE dim {" ".join(f"WHEN '{d}' THEN {w}" for d, w in LAMBDAS.items())} ELSE 0 END) AS total FROM vi GROUP BY vec_id),
lb AS (SELECT *, CASE WHEN total > 0.05 THEN 'proponent' WHEN total < -0.05 THEN 'opponent' ELSE 'neutral' END AS label FROM la),
w0 AS (SELECT *, CASE label WHEN 'proponent' THEN 1 + total WHEN 'opponent' THEN greatest(0.01, 1 + total) ELSE 1 END AS raw FROM lb),
iw AS MATERIALIZED (SELECT vec_id, label, total, raw / avg(raw) OVER () AS weight FROM w0)"""


@query("multi_objective", f"WITH {TOTAL} SELECT vec_id, {', '.join(f'round({d}_score, 6) AS {d}_score' for d in DIMS)}, round(total, 6) AS total_score FROM la")
def multi_objective(spark, sf_dir):
    found = influence.multi_objective(influences(spark, sf_dir), "vec_id", LAMBDAS)
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


def selected(spark, sf_dir):
    return selectors.get_selector("multi_obj_tracin")(samples(spark, sf_dir), "vec_id", influences(spark, sf_dir), LAMBDAS)


@query("classify_labels", f"WITH {TOTAL} SELECT vec_id, label AS p3_label FROM lb")
def classify_labels(spark, sf_dir):
    return selected(spark, sf_dir).select("vec_id", "p3_label")


@query("initial_weights", f"WITH {TOTAL} SELECT vec_id, label AS p3_label, round(weight, 6) AS weight FROM iw")
def initial_weights(spark, sf_dir):
    return selected(spark, sf_dir).select("vec_id", "p3_label", F.round("weight", 6).alias("weight"))


@query(
    "reweight_rounds",
    f"""WITH {TOTAL}, ro AS (SELECT vec_id, label, r AS round, weight * pow(CASE label WHEN 'proponent' THEN 2.0 WHEN 'opponent' THEN 0.5 ELSE 1.0 END, r) AS w, weight FROM iw, (SELECT unnest(range(0, 5)) AS r))
SELECT vec_id, round, round(CASE WHEN round = 0 THEN weight ELSE w / sum(w) OVER (PARTITION BY round) END, 9) AS weight FROM ro""",
)
def reweight_rounds(spark, sf_dir):
    first = selected(spark, sf_dir).select("vec_id", F.col("p3_label").alias("label"), "weight")
    return influence.rounds(first, "vec_id", "label", 4).select("vec_id", "round", F.round("weight", 9).alias("weight"))


@query(
    "influence_report",
    f"""WITH {TOTAL} SELECT {", ".join(f"count(*) FILTER (WHERE label = '{x}') AS n_{x}" for x in ("proponent", "opponent", "neutral"))}, count(*) AS n,
  round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight, round(avg(weight), 6) AS mean_weight FROM iw""",
)
def influence_report(spark, sf_dir):
    r = influence.report(selected(spark, sf_dir), "p3_label")
    return r.select("n_proponent", "n_opponent", "n_neutral", "n", *[F.round(c, 6).alias(c) for c in ("min_weight", "max_weight", "mean_weight")])


@query("round_rates", "SELECT round, 1e-3 * pow(0.5, round - 1) AS lr, 42 + round AS seed FROM (SELECT DISTINCT CAST(label + 1 AS BIGINT) AS round FROM embeddings)")
def round_rates(spark, sf_dir):
    rounds = samples(spark, sf_dir).select((F.col("label") + 1).cast("long").alias("round")).distinct()
    return rounds.select("round", (1e-3 * F.pow(F.lit(0.5), F.col("round") - 1)).alias("lr"), (42 + F.col("round")).alias("seed"))


@query("checkpoint_retention", "SELECT DISTINCT CAST(date_part('day', ts) * 50 AS BIGINT) AS step FROM events ORDER BY step DESC LIMIT 5")
def checkpoint_retention(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select((F.dayofmonth("ts") * 50).cast("string").alias("step"))
    return tables.retained(tables.checkpoint_steps(steps), 5)


@query(
    "checkpoint_subsample",
    """WITH s AS (SELECT list(DISTINCT CAST(date_part('day', ts) * 50 AS BIGINT) ORDER BY CAST(date_part('day', ts) * 50 AS BIGINT)) AS l FROM events)
SELECT DISTINCT unnest(CASE WHEN len(l) <= 6 THEN l ELSE list_concat([l[1]], list_transform(range(1, 6), lambda k: l[1 + CAST(floor(k * (len(l) - 1) / 5.0) AS BIGINT)])) END) AS step FROM s""",
)
def checkpoint_subsample(spark, sf_dir):
    steps = tables.checkpoint_steps(table(spark, sf_dir, "events").select((F.dayofmonth("ts") * 50).alias("step")))
    few = tables.spread([r["step"] for r in steps.collect()])  # a checkpoint's number each
    return steps.where(F.col("step").isin(few))


@query(
    "size_ledger",
    f"""WITH {CUT} SELECT 'raw' AS phase, count(*) AS rows FROM embeddings UNION ALL SELECT 'phase1', (SELECT least(count(*) FILTER (WHERE NOT is_outlier), greatest(100, count(*) // 5)) FROM o)
UNION ALL SELECT 'phase3', count(*) FROM embeddings""",
)
def size_ledger(spark, sf_dir):
    each = {"phase1": phase1_select(spark, sf_dir), "phase3": classify_labels(spark, sf_dir)}
    return selectors.ledger(raw=samples(spark, sf_dir), **{name: tables.written(df, name) for name, df in each.items()})


@query(
    "pooled_means",
    """WITH x AS (SELECT label, vec_id % 3 <> 0 AS m, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
p AS (SELECT label, i, sum(CASE WHEN m THEN v ELSE 0 END) / greatest(sum(CAST(m AS INTEGER)), 1) AS v FROM x GROUP BY ALL)
SELECT label, count(*) AS size, round(sqrt(sum(v * v)), 6) AS norm FROM p GROUP BY label""",
)
def pooled_means(spark, sf_dir):
    """Each class is a sample, its vectors are its tokens' hidden states, and every third of them is padding."""
    states = samples(spark, sf_dir).withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return selectors.pooled(states, "label", "embedding", "mask").select("label", F.size("embedding").cast("long").alias("size"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("score_store", f"WITH {INFLUENCE} SELECT vec_id, dim, round(score, 6) AS score FROM vi WHERE dim <> 'chat'")
def score_store(spark, sf_dir):
    """Validation influence written by dimension, one dimension replaced by itself, and read again without one."""
    path, found = tables.scratch(spark, "store"), tables.written(influences(spark, sf_dir), "influence")
    tables.write_scores(found, path, ["dim"])
    tables.write_scores(found.where("dim = 'safety'"), path, ["dim"])
    return tables.read_scores(spark, path).where("dim <> 'chat'").select("vec_id", "dim", F.round("score", 6).alias("score"))


@query("resumed_influence", f"WITH {MODEL} SELECT vec_id, round(score, 6) AS score FROM si")
def resumed_influence(spark, sf_dir):
    """Self-influence checkpoint by checkpoint, broken off after two of three, and taken up again."""
    x, path = samples(spark, sf_dir), tables.scratch(spark, "resumed")
    points = {c.step: c for c in checkpoints(x)}
    one = lambda step: influence.gradient_norms(x, "vec_id", SoftmaxScorer(), [points[step]]).select("vec_id", "norm2")
    tables.resumed(spark, path, [1, 2], one)
    each = tables.resumed(spark, path, [1, 2, 3], one)
    return each.groupBy("vec_id").agg(F.round(F.sum("norm2") / 3, 6).alias("score"))


@query(
    "checkpoint_load",
    """WITH m AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT 'layer.' || label || '.lora_A.weight' AS name, [CAST(n * 2 AS DOUBLE)] AS values FROM m""",
)
def checkpoint_load(spark, sf_dir):
    """Parameters saved under wrapped names at three steps, of which the newest two stay, and loaded by the model's own names."""
    path, n = tables.scratch(spark, "checkpoints"), samples(spark, sf_dir).groupBy("label").count()
    for step in (50, 100, 200):
        value = F.array((F.col("count") * (step / 100)).cast("double")).alias("values")
        name = F.concat(F.lit("base_model.model.layer."), F.col("label").cast("string"), F.lit(".lora_A.default.weight")).alias("name")
        tables.write_checkpoint(n.select(name, value), path, step)
    newest = tables.prune_checkpoints(spark, path, 2)[-1]
    names = n.select(F.concat(F.lit("layer."), F.col("label").cast("string"), F.lit(".lora_A.weight")).alias("name"))
    return tables.load_checkpoint(spark.read.parquet(path), names, newest).select("name", "values")


@query(
    "three_phases",
    f"""WITH {CUT}, a AS (SELECT vec_id FROM o WHERE NOT is_outlier ORDER BY score, vec_id LIMIT (SELECT greatest(100, count(*) // 5) FROM embeddings)),
b AS (SELECT vec_id % 25 AS step, count(*) AS n FROM a GROUP BY ALL)
SELECT 'raw' AS phase, count(*) AS rows FROM embeddings UNION ALL SELECT 'screening', count(*) FROM a UNION ALL SELECT 'batches', CAST(sum(least(n, 3)) AS BIGINT) FROM b
UNION ALL SELECT 'reweighting', count(*) FROM a UNION ALL SELECT 'final', count(*) FROM a""",
)
def three_phases(spark, sf_dir):
    """The ledger of a run of all three phases."""
    x = samples(spark, sf_dir)
    points = checkpoints(x)
    losses = influence.gradient_norms(x, "vec_id", SoftmaxScorer(), points[-1:]).select("vec_id", (F.col("vec_id") % 25).alias("step"), "loss")
    gradients = influence.mean_gradients(x.where(is_validation()).withColumn("dim", dim()), "dim", SoftmaxScorer(), points)
    layers = [{"batches": {"batch": 3, "length": 25}, "reweighting": {"lambdas": LAMBDAS}}]
    return phases.run(x, phases.Model(SoftmaxScorer(), points, "vec_id"), losses, gradients, layers, ["batches.strategy=cosine"]).ledger
