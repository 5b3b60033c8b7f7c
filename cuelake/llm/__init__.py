"""Operators on the language of transcripts and documents for training-data pipelines, with their queries and SQL.

Nothing outside this package imports it.
"""

from __future__ import annotations

from collections.abc import Callable

from cuelake.llm import queries as _queries

MODULES = (_queries,)


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
