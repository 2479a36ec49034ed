"""Sparse incidence algebra: every matrix is a table (i, j, val) without zeros, every product a join and a sum.

A boundary matrix B_k has rows i = (k-1)-cells and columns j = k-cells. Values are BIGINT, so Laplacians and their
powers are exact, and opposite signs cancel as they do in the matrices. Products are grouped sums over an equi-join on
the contracted index: partial sums are combined before the shuffle, and zeros are dropped before the next product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(df: DataFrame) -> DataFrame:
    return df.groupBy("i", "j").agg(F.sum("val").alias("val")).filter("val <> 0")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a · b."""
    left = a.select("i", F.col("j").alias("k"), F.col("val").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("val").alias("y"))
    return _sum(left.join(right, "k").select("i", "j", (F.col("x") * F.col("y")).alias("val")))


def add(*ms: DataFrame) -> DataFrame:
    """Sum of matrices; what cancels is no entry."""
    return _sum(reduce(DataFrame.unionByName, [m.select("i", "j", "val") for m in ms]))


def scale(m: DataFrame, by: float | int) -> DataFrame:
    return m.select("i", "j", (F.col("val") * by).alias("val"))


def lower_laplacian(b: DataFrame) -> DataFrame:
    """BᵀB: k-cells that share a face."""
    return product(transpose(b), b)


def upper_laplacian(b: DataFrame) -> DataFrame:
    """BBᵀ of the next boundary: k-cells that share a coface."""
    return product(b, transpose(b))


def laplacians(boundaries: dict[int, DataFrame], dim: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(lower, upper) Laplacian of ``dim``; a side without its boundary is None."""
    if dim not in (0, 1, 2):
        raise ValueError(f"no Laplacian for dimension {dim}")
    lower, upper = boundaries.get(dim), boundaries.get(dim + 1)
    if lower is None and upper is None:
        raise ValueError(f"dimension {dim} needs a boundary below or above it")
    return (lower_laplacian(lower) if lower is not None else None, upper_laplacian(upper) if upper is not None else None)


def hodge(boundaries: dict[int, DataFrame], dim: int) -> DataFrame:
    """Lower plus upper Laplacian."""
    return add(*(m for m in laplacians(boundaries, dim) if m is not None))


def off_diagonal(m: DataFrame) -> DataFrame:
    return m.filter("i <> j")


def identity(ids: DataFrame, value: Column | None = None) -> DataFrame:
    """Identity over a one-column table of cell ids."""
    cell = F.col(ids.columns[0])
    return ids.select(cell.alias("i"), cell.alias("j"), (value if value is not None else F.lit(1).cast("long")).alias("val"))


def power(m: DataFrame, q: int, zero_diagonal: bool = False) -> DataFrame:
    """m^q by q - 1 products; with ``zero_diagonal`` of the matrix without its diagonal."""
    if q < 1:
        raise ValueError("the power must be 1 or more")
    base = off_diagonal(m) if zero_diagonal else m
    return reduce(product, [base] * q)


def powers(m: DataFrame, most: int, first: int = 1) -> DataFrame:
    """(k, i, j, val) of m^k for k = first..most."""
    if first < 1 or most < first:
        raise ValueError("powers run from 1 or more")
    out, current = [], power(m, first)
    for k in range(first, most + 1):
        current = current if k == first else product(current, m)
        out.append(current.select(F.lit(k).cast("long").alias("k"), "i", "j", "val"))
    return reduce(DataFrame.unionByName, out)


def each_times(stack: DataFrame, b: DataFrame) -> DataFrame:
    """(k, i, j, val) · b, power by power."""
    left = stack.select("k", "i", F.col("j").alias("m"), F.col("val").alias("x"))
    right = b.select(F.col("i").alias("m"), "j", F.col("val").alias("y"))
    return left.join(right, "m").groupBy("k", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("val")).filter("val <> 0")


def apply(m: DataFrame, signal: DataFrame, value: str = "x") -> DataFrame:
    """m · x_t for all t: (i, t, value); cells without an entry have no row."""
    own = signal.select(F.col("cell_id").alias("j"), "t", F.col(value).alias("x"))
    return m.join(own, "j").groupBy("i", "t").agg(F.sum(F.col("val") * F.col("x")).alias(value))


def submatrix(m: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Entries whose row and column are in the given one-column tables."""
    if rows is not None:
        m = m.join(rows.select(F.col(rows.columns[0]).alias("i")).distinct(), "i", "left_semi")
    if columns is not None:
        m = m.join(columns.select(F.col(columns.columns[0]).alias("j")).distinct(), "j", "left_semi")
    return m.select("i", "j", "val")


def smoothing(cells: DataFrame, lower: DataFrame | None, upper: DataFrame | None, mu_lower: float, mu_upper: float) -> DataFrame:
    """I + μ_l L_lower + μ_u L_upper."""
    parts = [identity(cells, F.lit(1.0))]
    parts += [scale(m, mu) for m, mu in ((lower, mu_lower), (upper, mu_upper)) if m is not None]
    return add(*parts)


def gram(x: DataFrame, by: list[str], row: str = "i", column: str = "f", value: str = "s", weight: DataFrame | None = None) -> DataFrame:
    """XᵀRX per group: (by, f, g, val); R is the identity or (i, j, val).

    XᵀX is dealt by group, so that its sums, which are as many as pairs of columns for each row, need no shuffle of their own;
    a row's pairs are streamed, and as XᵀX is symmetric one triangle is summed up."""
    if weight is None:
        rows = x.repartition(*by).groupBy(*by, row).agg(F.collect_list(F.struct(F.col(column).alias("f"), F.col(value).alias("a"))).alias("all"))
        pairs = rows.select(*by, "all", F.explode("all").alias("l")).select(*by, "l", F.explode("all").alias("r")).filter("l.f <= r.f")
        half = pairs.groupBy(*by, F.col("l.f").alias("f"), F.col("r.f").alias("g")).agg(F.sum(F.col("l.a") * F.col("r.a")).alias("val"))
        one, other = F.struct("f", "g"), F.struct(F.col("g").alias("f"), F.col("f").alias("g"))
        return half.select(*by, F.explode(F.when(F.col("f") == F.col("g"), F.array(one)).otherwise(F.array(one, other))).alias("at"), "val").select(*by, "at.f", "at.g", "val")
    left, right = x.select(*by, F.col(row).alias("i"), F.col(column).alias("f"), F.col(value).alias("a")), x.select(*by, F.col(row).alias("j"), F.col(column).alias("g"), F.col(value).alias("b"))
    pairs = left.join(weight, "i").join(right, [*by, "j"])
    return pairs.groupBy(*by, "f", "g").agg(F.sum(F.col("a") * F.col("val") * F.col("b")).alias("val"))
