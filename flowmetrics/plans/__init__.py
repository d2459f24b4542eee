"""Registered query catalogue."""

from .registry import oracle_sql, queries  # noqa: F401
