"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from pairloom.plans import (  # noqa: F401
    expression_queries,
    identifier_queries,
    model_queries,
    pair_queries,
    ranking_queries,
    split_queries,
)
from pairloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
