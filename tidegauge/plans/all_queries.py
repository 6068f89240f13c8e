"""All queries of the ordered-series library."""

from __future__ import annotations

from tidegauge.plans import entry_queries, indicator_queries, market_queries, structure_queries  # noqa: F401  (register their queries)
from tidegauge.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
