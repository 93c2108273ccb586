"""All catalogue queries and their oracle texts."""

from __future__ import annotations

from . import evaluation_queries, feature_queries, further_queries, insight_queries, missing_queries, model_queries, source_queries, stat_queries, training_queries
from .shared import TIE_SHIFT

MODULES = [insight_queries, feature_queries, stat_queries, missing_queries, source_queries, evaluation_queries, model_queries, training_queries, further_queries]


def all_queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def all_oracles() -> dict:
    """Oracle texts with the tie shift of :func:`shared.rounded` put into every ``round``."""
    shifted = f"round({TIE_SHIFT!r}::double + "
    return {k: s.replace("round(", shifted) for m in MODULES for k, s in m.ORACLES.items()}
