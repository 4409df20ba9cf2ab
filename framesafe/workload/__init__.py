"""The driver's queries: domain views over the given tables, one query per operator, and the same in SQL."""

from __future__ import annotations


def load():
    """All queries and their SQL, by name."""
    from . import box_queries, catalog_queries, display_queries, identity_queries, privacy_queries, time_queries  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
