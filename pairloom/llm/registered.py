"""All queries of this subpackage; importing the modules fills the registry."""

from __future__ import annotations

from pairloom.llm import (  # noqa: F401
    decontaminate,
    html_extract,
    line_dedup,
    mixing,
    ngram_join,
    periodic_runs,
    pii,
    quality_model,
    quality_rules,
    secrets,
    token_counts,
    token_files,
    vector_codes,
)
from pairloom.llm.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
