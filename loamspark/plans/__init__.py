"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import batching, changes, chat, concepts, events, facts, governance, graph, intake, knowledge, made, memory, recrawl, relational, structured, texts, threads, untrusted, web  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
