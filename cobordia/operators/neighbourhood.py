"""Topological neighbourhoods: which cells are next to, below or above which."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobordia.operators import incidence as A

Boundaries = dict[int, DataFrame]


def graph(m: DataFrame) -> DataFrame:
    """Undirected graph of a symmetric matrix: (i, j) of its off-diagonal entries."""
    return A.off_diagonal(m).select("i", "j")


def edge_adjacency(boundaries: Boundaries) -> DataFrame:
    """Edges next to each other by the signed Hodge Laplacian: what cancels is not adjacent."""
    return graph(A.hodge(boundaries, 1))


def self_adjacency(m: DataFrame, q: int, zero_diagonal: bool = False) -> DataFrame:
    """Off-diagonal support of m^q, signs and all."""
    if q < 0:
        raise ValueError("Q must not be negative")
    return graph(A.power(m, q, zero_diagonal)) if q else m.limit(0).select("i", "j")


def cells(boundaries: Boundaries) -> DataFrame:
    """(dim, cell_id) of all cells that a boundary names."""
    found = [b.select(F.lit(k + d).cast("long").alias("dim"), F.col(side).alias("cell_id")) for k, b in boundaries.items() for d, side in ((-1, "i"), (0, "j"))]
    return reduce(DataFrame.unionByName, found).distinct()


def cell_counts(all_cells: DataFrame) -> DataFrame:
    return all_cells.groupBy("dim").agg(F.count("*").alias("n"))


def below(boundaries: Boundaries, dim: int, steps: int) -> DataFrame:
    """(cell_from, cell_to): cells ``steps`` dimensions below each cell of ``dim``."""
    at = boundaries[dim].select(F.col("j").alias("cell_from"), F.col("i").alias("cell_to"))
    for k in range(dim - 1, dim - steps, -1):
        at = at.join(boundaries[k].select(F.col("j").alias("cell_to"), F.col("i").alias("next")), "cell_to").select("cell_from", F.col("next").alias("cell_to")).distinct()
    return at.distinct()


def above(boundaries: Boundaries, dim: int, steps: int) -> DataFrame:
    down = below(boundaries, dim + steps, steps)
    return down.select(F.col("cell_to").alias("cell_from"), F.col("cell_from").alias("cell_to"))


def adjacency(boundaries: Boundaries, own: bool = True) -> DataFrame:
    """Adjacency trees (dim_from, cell_from, dim_to, cell_to): faces and cofaces of every order by incidence alone, and
    with ``own`` the cells of the same dimension that the Hodge Laplacian joins, a cell itself included."""
    top, out = max(boundaries), []
    for dim in range(min(boundaries) - 1, top + 1):
        found = [(dim - s, below(boundaries, dim, s)) for s in range(1, dim + 1) if dim - s + 1 in boundaries]
        found += [(dim + s, above(boundaries, dim, s)) for s in range(1, top - dim + 1)]
        if own:
            near = A.hodge(boundaries, dim).select(F.col("i").alias("cell_from"), F.col("j").alias("cell_to"))
            found.append((dim, near))
        out += [d.select(F.lit(dim).cast("long").alias("dim_from"), "cell_from", F.lit(to).cast("long").alias("dim_to"), "cell_to") for to, d in found]
    return reduce(DataFrame.unionByName, out)


def reached(owned: DataFrame, near: DataFrame) -> DataFrame:
    """Cells (cluster_id, cell_id) that the adjacency (i, j) reaches from a cluster's owned cells."""
    return owned.select("cluster_id", F.col("cell_id").alias("i")).join(near, "i").select("cluster_id", F.col("j").alias("cell_id")).distinct()


def boundary_of_boundary(b1: DataFrame, b2: DataFrame) -> DataFrame:
    """Number of non-zero entries of B1·B2: 0 for a complex."""
    return A.product(b1, b2).agg(F.count("*").alias("nonzero"))
