"""Where queries and their SQL are collected."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conformance.views import VIEWS, duckdb_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Further named statements that oracle SQL may build on, in dependency order.
BLOCKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` names register views and blocks as ``v_<name>``."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql.strip()


def _needed(sql: str, found: dict[str, str]) -> None:
    for name in re.findall(r"\bv_(\w+)\b", sql):
        if name in found or (name not in VIEWS and name not in BLOCKS):
            continue
        text = duckdb_view(name) if name in VIEWS else BLOCKS[name]
        _needed(text, found)
        found[name] = text


def with_views(sql: str) -> str:
    """Put the definitions of all views and blocks a statement needs in front of it."""
    found: dict[str, str] = {}
    _needed(sql, found)
    body = sql.strip()
    if not found:
        return body
    ctes = ",\n".join(f"v_{name} as ({text})" for name, text in found.items())
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
