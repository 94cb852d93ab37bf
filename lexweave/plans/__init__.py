"""Registered queries and their DuckDB texts."""

from . import queries, tagging

__all__ = ["queries", "tagging"]
