"""Registered queries: fixtures derived from the driver's tables, and their DuckDB SQL."""
