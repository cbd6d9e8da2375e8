"""Selectors: a pool in, the chosen rows out, by name.

A selector is a function (pool, id_col, **options) -> DataFrame; register() adds others. Numbers of rows to keep are
max(1, n * fraction); of equal scores the larger id is kept, as the end of a stable ascending sort has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import pool_text
from ..functions.vectors import unit
from ..sources.tables import written
from . import clusters, influence, ngrams, quantiles, sampling, scalar_clusters, token_loss
from .array_sums import array_sums
from .scalars import beside

SELECTORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        if name in SELECTORS:
            raise ValueError(f"selector {name!r} is registered twice")
        SELECTORS[name] = f
        return f

    return add


def get_selector(name: str) -> Callable[..., DataFrame]:
    if name not in SELECTORS:
        raise LookupError(f"no selector {name!r}; there are {', '.join(list_selectors())}")
    return SELECTORS[name]


def list_selectors() -> list[str]:
    return sorted(SELECTORS)


def top(scored: DataFrame, id_col: str, score: str, k: int) -> DataFrame:
    """The k rows of the highest scores. They are written first, as sums of scores can differ in their last bits from run to run."""
    return sampling.first_rows(written(scored, "scored"), k, score, id_col, descending=True)


def chosen(pool: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return pool.join(ids, id_col)


@register("full")
def full(pool: DataFrame, id_col: str) -> DataFrame:
    return pool


@register("uniform")
def uniform(pool: DataFrame, id_col: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    return sampling.hash_sample(pool, id_col, sampling.share(pool.count(), fraction), seed)


@register("dsir")
def dsir(pool: DataFrame, id_col: str, fraction: float = 0.2, target: DataFrame | None = None, n: int = 3, features: int = 10_000) -> DataFrame:
    """By n-gram match with the target; without one, with the first tenth of the pool."""
    rows = pool.count()
    text = pool.select(id_col, pool_text(pool).alias("__text"))
    aim = sampling.first_rows(text, max(1, rows // 10), id_col) if target is None else target.select(id_col, pool_text(target).alias("__text"))
    weights = ngrams.gram_weights(text, aim, id_col, "__text", n, features)
    return chosen(pool, top(weights.select(id_col, "weight"), id_col, "weight", sampling.share(rows, fraction)), id_col)


def proxy_scores(pool: DataFrame, id_col: str, vector: str, proxy: DataFrame) -> DataFrame:
    """id and score, the mean cosine with the proxy's vectors: the inner product of the unit vector with their mean unit vector."""
    parts = proxy.select(F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    mean = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("__sum"))
    n = proxy.agg(F.count(F.lit(1)).alias("__n"))
    both = beside(beside(pool.select(id_col, unit(F.col(vector)).alias("__u")), mean), n)
    total = F.aggregate(F.zip_with("__u", "__sum", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return both.select(id_col, F.coalesce(total / F.col("__n"), F.lit(0.0)).alias("score"))


def pooled(tokens: DataFrame, id_col: str, vector: str, mask: str) -> DataFrame:
    """id and vector, a representation of each sample: the mean of its tokens' hidden states where the mask is 1; zeros where it is nowhere.
    tokens has a row for each token."""
    sums = array_sums(tokens, [id_col], vector, F.coalesce(F.col(mask).cast("double"), F.lit(0.0)))
    return sums.select(id_col, F.transform("total", lambda x: x / F.greatest(F.col("n"), F.lit(1.0))).alias(vector))


def proxy_rows(pool: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """A proxy validation set from the pool itself: a tenth of it, 100 rows at most; of fewer than ten rows, none."""
    return sampling.hash_sample(pool, id_col, min(100, pool.count() // 10), seed)


@register("less")
def less(
    pool: DataFrame, id_col: str, vector: str = "embedding", fraction: float = 0.2, proxy: DataFrame | None = None, seed: int = 42, tokens: DataFrame | None = None, mask: str = "attention_mask"
) -> DataFrame:
    """By the mean cosine with the proxy. With tokens (id, mask, vector: a row for each token), the vectors are their means."""
    if tokens is not None:
        found = less(written(pooled(tokens, id_col, vector, mask), "pooled"), id_col, vector, fraction, proxy, seed)
        return chosen(pool, found.select(id_col), id_col)
    proxy = proxy_rows(pool, id_col, seed) if proxy is None else proxy
    scores = proxy_scores(pool, id_col, vector, proxy)
    return chosen(pool, top(scores, id_col, "score", sampling.share(pool.count(), fraction)), id_col)


@register("rho_loss")
def rho_loss(
    pool: DataFrame, id_col: str, losses: DataFrame | None = None, fraction: float = 0.2, holdout: float = 0.05, seed: int = 42, reference: DataFrame | None = None, model: token_loss.Model | None = None
) -> DataFrame:
    """The candidates (all but a holdout) of the largest loss; with reference losses (id, loss), of the largest difference.

    Without losses, the pool has token arrays (input_ids, labels): they are those under the model, and without reference losses those
    under a model of the holdout are the reference, as what the holdout teaches anyway. Samples without a predicted token have no loss and are not chosen.
    """
    split = sampling.split_holdout(pool, id_col, holdout, 10, seed)
    rows = split.where("not holdout").drop("holdout")
    if losses is None:
        if model is None:
            raise ValueError("rho_loss needs losses, or a model of tokens")
        losses = token_loss.token_losses(pool, id_col, model)
        if reference is None:
            reference = token_loss.token_losses(pool, id_col, token_loss.fit(split.where("holdout"), model.coding.order, model.coding.vocabulary))
    scores = losses.select(id_col, F.col("loss").alias("score"))
    if reference is not None:
        scores = scores.join(reference.select(id_col, F.col("loss").alias("__r")), id_col).select(id_col, (F.col("score") - F.col("__r")).alias("score"))
    scores = scores.where("score is not null")
    return chosen(rows, top(rows.select(id_col).join(scores, id_col), id_col, "score", sampling.share(pool.count(), fraction)), id_col)


@register("importance_sampling")
def importance(pool: DataFrame, id_col: str, losses: DataFrame | None = None, step: str = "step", loss: str = "loss", **how) -> DataFrame:
    """An online selector: without losses the pool stays. With those of some steps (id, step, loss) it gives the rows of their guarded batches, with step,
    p and weight; how: of sampling.guarded_batches()."""
    if losses is None:
        return pool
    drawn = sampling.guarded_batches(losses, id_col, step, loss, **how)
    return pool.join(drawn.select(id_col, step, "p", "weight"), id_col)


def outliers(scores: DataFrame, percentile: float = 95.0) -> DataFrame:
    """scores with is_outlier: at or above the exact percentile, by linear interpolation. Both are rounded alike before they meet.

    The scores are written first, as sums of scores can differ in their last bits from run to run; without any there are no outliers.
    """
    scores = written(scores, "scores")
    cut = quantiles.percentiles(scores, "score", [percentile / 100])[0]
    is_outlier = F.lit(False) if cut is None else F.coalesce(F.round("score", 9) >= F.round(F.lit(cut), 9), F.lit(False))
    return scores.withColumn("is_outlier", is_outlier)


def kept_rows(labelled: DataFrame, id_col: str, least: int = 5000, most: int = 50_000, fraction: float = 0.2, sentinel: int = 50_000) -> DataFrame:
    """What of clean and representative rows is kept: with fewer than ``least`` of them all that are no outliers, and of these the ``most`` of lowest score.

    The sentinel stands for max(100, n * fraction).
    """
    labelled = written(labelled, "labelled")  # read more than once, and sums of scores can differ in their last bits
    n = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isin("clean", "representative")).alias("good")).first()
    cap = max(100, int(n["n"] * fraction)) if fraction > 0 and most == sentinel else most
    good = labelled.where(F.col("label").isin("clean", "representative") if n["good"] >= least else F.col("label") != "outlier")
    return sampling.first_rows(good, cap, "score", id_col)


@register("tracin_cp")
def tracin(
    pool: DataFrame, id_col: str, scores: DataFrame, percentile: float = 95.0, method: str = "none", k: int | None = None, least: int = 5000, most: int = 50_000, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Phase 1 on self-influence (id, score): outliers go, near-equal scores may be thinned to representatives, and the cleanest
    (lowest) are kept. Adds influence_score and p1_label."""
    marked = outliers(scores.select(id_col, "score"), percentile)
    clean = marked.where("not is_outlier")
    if method != "none" and (n := clean.count()) > 10:
        number = k or clusters.default_clusters(n)
        if method == "kmeans":
            grouped = scalar_clusters.scalar_kmeans(clean, "score", number)
        else:
            grouped = clusters.fit_clusters(clean.withColumn("__x", F.array(F.col("score"))), "__x", number, method, seed)
        # a single positive score has cosine distance 0 to its mean: the first member stands for the cluster
        first = influence.nearest_of_cluster(grouped.withColumn("__d", F.lit(0)), "cluster", "__d", id_col).select(id_col, F.lit(True).alias("__first"))
        marked = marked.join(first, id_col, "left")
        label = F.when(F.col("is_outlier"), "outlier").when(F.col("__first"), "representative").otherwise("redundant")
    else:
        label = F.when(F.col("is_outlier"), "outlier").otherwise("representative")
    labelled = marked.select(id_col, "score", label.alias("label"))
    kept = kept_rows(labelled, id_col, least, most, fraction)
    return pool.join(kept.select(id_col, F.col("score").alias("influence_score"), F.col("label").alias("p1_label")), id_col)


@register("multi_obj_tracin")
def multi_objective(pool: DataFrame, id_col: str, scores: DataFrame, lambdas: dict[str, float], threshold: float = 0.05) -> DataFrame:
    """Phase 3 on validation influence (id, dim, score): adds influence_total_score, p3_label and weight. All rows stay."""
    total = influence.multi_objective(scores, id_col, lambdas).select(id_col, F.col("total_score").alias("influence_total_score"))
    labelled = total.withColumn("p3_label", influence.classify(F.col("influence_total_score"), threshold))
    weights = influence.initial_weights(labelled, id_col, "influence_total_score", "p3_label")
    return pool.join(labelled.join(weights.select(id_col, "weight"), id_col), id_col)


def ledger(**phases: DataFrame) -> DataFrame:
    """phase and rows of each frame, in one frame."""
    out = None
    for name, df in phases.items():
        one = df.agg(F.lit(name).alias("phase"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


