"""Queries over the driver's tables, one or more for each operator."""

from . import cleaning_queries, map_queries, sequence_queries, source_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
