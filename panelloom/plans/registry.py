"""Registered queries and their oracle SQL."""

from __future__ import annotations

from panelloom.plans import evaluation_queries, extra_queries, factor_queries, fundamental_queries, merge_queries, more_queries, panel_queries, portfolio_queries, wide_queries

MODULES = (factor_queries, panel_queries, more_queries, extra_queries, evaluation_queries, fundamental_queries, portfolio_queries, wide_queries, merge_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
