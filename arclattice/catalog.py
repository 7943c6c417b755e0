"""Registry of the queries."""

from __future__ import annotations

from collections.abc import Callable

from .plans import grid, perception, services, sqltext, tracking

_ALL = grid.QUERIES | perception.QUERIES | tracking.QUERIES | services.QUERIES | sqltext.QUERIES


def queries() -> dict[str, Callable]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
