"""All queries of the core and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from cuelake.plans import general, reference

MODULES = (general, reference)
FLAGSHIP = "topic_chapters"


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
