"""Every query of the code-graph operators with its SQL."""

from __future__ import annotations

from spandrel.plans import code_queries, content_queries, detail_queries, graph_queries, listing_queries, nested_queries, project_queries, relation_queries, relevance_queries, stream_queries, text_queries  # noqa: F401
from spandrel.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
