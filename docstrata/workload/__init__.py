"""The checked queries."""

from __future__ import annotations

from docstrata.workload import (  # noqa: F401
    file_queries,
    index_queries,
    search_queries,
    stats_queries,
    stream_queries,
    text_queries,
)
from docstrata.workload.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
