"""All registered queries of the ad-analytics operators and their DuckDB oracles."""

from __future__ import annotations

from admeridian.plans import account_queries, audit_queries, detector_queries, learn_queries, library_queries, normalise_queries, operate_queries, web_queries

MODULES = [account_queries, detector_queries, learn_queries, library_queries, web_queries, operate_queries, normalise_queries, audit_queries, library_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
