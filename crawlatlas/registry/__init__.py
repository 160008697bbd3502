"""Registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from crawlatlas.registry.base import QUERIES, SQL

# Importing a module registers its queries.
from crawlatlas.registry import (  # noqa: E402,F401  isort:skip
    sources, projections, predicates, joins, rollups, ordering, urls, scope, outcomes, updates, streams,
)

__all__ = ["QUERIES", "SQL"]
