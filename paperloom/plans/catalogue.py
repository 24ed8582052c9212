"""All query modules of the core."""

from __future__ import annotations

from . import change_queries, conversation_queries, library_queries, lookup_queries, section_queries
from .registry import Query

MODULES = (library_queries, conversation_queries, section_queries, change_queries, lookup_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.REGISTRY.queries.items()}


def sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.REGISTRY.sql.items()}
