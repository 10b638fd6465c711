"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import catalog_queries, curate_queries, eval_queries, evaluation_queries, index_queries, stats_queries, stream_queries, text_queries, workflow_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
from .eval_queries import flagship  # noqa: F401
