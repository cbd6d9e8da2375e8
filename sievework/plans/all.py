"""Importing this registers every query."""

from . import evaluation_queries, influence_queries, loss_queries, sampling_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
