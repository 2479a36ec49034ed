"""Registered queries of the cell-complex engine and their DuckDB SQL."""

from __future__ import annotations

from cobordia.plans import runs, signals, streams, topology

MODULES = (topology, signals, runs, streams)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
