"""Operators of a training-data pipeline, one module each.

Every module holds the general operator and, at its end, the thin
``opN_<name>(spark, sf_dir)`` query that the repository registers.
"""

from __future__ import annotations

from coexnet.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
