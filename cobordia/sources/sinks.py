"""Sinks: metric series as Parquet, comparison tables as Markdown and LaTeX, the tables behind figures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def save_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric series, partitioned by case and dimension."""
    metrics.write.mode(mode).partitionBy("case_id", "dim").parquet(path)


def _cell(x) -> str:
    return str(x) if isinstance(x, str) else "nan" if x is None or not math.isfinite(x) else f"{x:.6e}"


def table_rows(table: DataFrame) -> list[list[str]]:
    """Header and rows of a report; it has a row per metric and a column per case, so it is small by nature."""
    return [table.columns, *[[_cell(x) for x in row] for row in sorted(table.collect(), key=lambda r: str(r[0]))]]


def markdown(table: DataFrame) -> str:
    head, *rows = table_rows(table)
    return "\n".join(f"| {' | '.join(r)} |" for r in [head, ["---"] * len(head), *rows]) + "\n"


def latex(table: DataFrame) -> str:
    lines = [" & ".join(x.replace("_", r"\_") for x in r) + r" \\" for r in table_rows(table)]
    columns = "l" + "r" * (len(table.columns) - 1)
    return "\n".join([rf"\begin{{tabular}}{{{columns}}}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"]) + "\n"
