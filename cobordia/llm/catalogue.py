"""Registered queries of the training-text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from cobordia.llm import alignment, chat, jaccard, licenses, mixing, neighbours, packing, passages, quality, resampling, tokencount, toxicity, urls

MODULES = (passages, mixing, licenses, tokencount, chat, toxicity, packing, jaccard, neighbours, quality, alignment, resampling, urls)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
