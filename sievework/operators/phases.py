"""The three phases as one run: screening by self-influence, importance batches, weights by validation influence."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..sources.tables import written
from . import influence, sampling, selectors
from .influence import Checkpoint, Scorer


@dataclass(frozen=True)
class Model:
    """What scores samples: a scorer, its checkpoints, and the name of the samples' key."""

    scorer: Scorer
    checkpoints: Sequence[Checkpoint]
    id_col: str


def screening(pool: DataFrame, model: Model, percentile: float = 95.0, method: str = "none", least: int = 5000, most: int = 50_000, fraction: float = 0.2, given_rates: bool = False) -> DataFrame:
    """The cleanest samples of the pool, with influence_score and p1_label."""
    scores = influence.self_influence(pool, model.id_col, model.scorer, model.checkpoints, given_rates)
    return selectors.get_selector("tracin_cp")(pool, model.id_col, scores, percentile=percentile, method=method, least=least, most=most, fraction=fraction)


def batches(
    losses: DataFrame, model: Model, batch: int = 4, multiplier: int = 4, strategy: str = "linear", length: int = 5000, clip: float = 10.0, seed: int = 42, alpha: float = 0.95, threshold: float = 0.05
) -> DataFrame:
    """The batch of every step of a table of losses (id, step, loss), uniform from where importance sampling no longer helps."""
    how = {"batch": batch, "multiplier": multiplier, "strategy": strategy, "length": length, "clip": clip, "seed": seed}
    return sampling.guarded_batches(losses, model.id_col, "step", "loss", alpha, threshold, **how)


def reweighting(pool: DataFrame, model: Model, gradients: DataFrame, lambdas: dict[str, float] | None = None, threshold: float = 0.05, normalize: bool = True) -> DataFrame:
    """The pool with influence_total_score, p3_label and weight. Weights of the dimensions must have the sum 1."""
    lambdas = lambdas or {}
    if abs(sum(lambdas.values()) - 1) > 0.01:
        raise ValueError(f"the weights of the dimensions must have the sum 1, not {sum(lambdas.values())}")
    scores = influence.validation_influence(pool, model.id_col, model.scorer, model.checkpoints, gradients, normalize)
    return selectors.get_selector("multi_obj_tracin")(pool, model.id_col, scores, lambdas, threshold)


STAGES: dict[str, Callable] = {"screening": screening, "batches": batches, "reweighting": reweighting}


@dataclass(frozen=True)
class Outcome:
    """The pool after the phases that are on, the batches of its steps if that phase is, and how many rows each phase left."""

    pool: DataFrame
    batches: DataFrame | None
    ledger: DataFrame


def run(
    pool: DataFrame, model: Model, losses: DataFrame | None = None, gradients: DataFrame | None = None, layers: Iterable[config.Layer] = (), texts: Iterable[str] = ()
) -> Outcome:
    """The phases one after the other, by the settings that config.settings() makes of layers and texts. Each phase's result is a table."""
    on = config.settings(STAGES, layers, texts)
    if on.get("batches", {}).get("strategy", sampling.STRATEGIES[0]) not in sampling.STRATEGIES:
        raise ValueError(f"batches.strategy must be one of {', '.join(sampling.STRATEGIES)}")
    rows, drawn = {"raw": pool}, None
    if "screening" in on:
        rows["screening"] = pool = written(screening(pool, model, **on["screening"]), "screening")
    if "batches" in on and losses is not None:
        kept = losses.join(pool.select(model.id_col), model.id_col, "left_semi")
        rows["batches"] = drawn = written(batches(kept, model, **on["batches"]), "batches")
    if "reweighting" in on:
        if gradients is None:
            raise ValueError("reweighting needs the mean gradients of the validation sets")
        rows["reweighting"] = pool = written(reweighting(pool, model, gradients, **on["reweighting"]), "reweighting")
    return Outcome(pool, drawn, selectors.ledger(**rows, final=pool))
