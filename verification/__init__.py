"""Queries over the test tables, each with an independent SQL formulation."""

from verification import (  # noqa: F401
    analytics_queries,
    brief_queries,
    function_queries,
    table_queries,
    text_queries,
)
from verification.core import QUERIES  # noqa: F401
