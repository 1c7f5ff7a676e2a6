"""All queries of the catalog operators."""

from __future__ import annotations

from shelfmerge.plans import base, q_expr, q_match, q_reports, q_sinks, q_standard, q_work  # noqa: F401  (they register)


def queries() -> dict[str, base.Query]:
    """Name to query."""
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(base.ORACLES)
