"""Agents: what each cluster of a partition stores, predicts, imports and exports, and how it weighs its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobordia.operators.partition import CELL, both_ways, local_complex


def local_signal(signal: DataFrame, index: DataFrame) -> DataFrame:
    """(cluster_id, dim, cell_id, t, x) of the cells in an index or ownership table."""
    return signal.join(index.select("cluster_id", *CELL), CELL).select("cluster_id", *CELL, "t", "x")


def partial_indices(index: DataFrame, owned: DataFrame) -> DataFrame:
    """Local cells with ``is_out``: owned ones are predicted; a cluster that owns none of a dimension predicts all."""
    own = owned.select("cluster_id", *CELL, F.lit(True).alias("own"))
    x = index.join(own, ["cluster_id", *CELL], "left")
    some = F.count("own").over(Window.partitionBy("cluster_id", "dim"))
    return x.select("cluster_id", "dim", "pos", "cell_id", (F.col("own").isNotNull() | (some == 0)).alias("is_out"))


def neighbour_interface(interface: DataFrame) -> DataFrame:
    return both_ways(interface)


def imports(needs: DataFrame, cluster: int) -> DataFrame:
    return needs.filter(F.col("src") == cluster).select(F.col("dst").alias("neighbour"), *CELL)


def exports(needs: DataFrame, cluster: int) -> DataFrame:
    return needs.filter(F.col("dst") == cluster).select(F.col("src").alias("neighbour"), *CELL)


def only_local(neighbours: DataFrame, index: DataFrame) -> DataFrame:
    """Neighbour maps (src, dst, dim, cell_id) less what ``src`` does not see; empty neighbours vanish with their rows."""
    own = index.select(F.col("cluster_id").alias("src"), *CELL)
    return neighbours.join(own, ["src", *CELL], "left_semi").select("src", "dst", *CELL)


def in_equals_out(index: DataFrame, owned: DataFrame) -> DataFrame:
    """Local index cut to owned cells, renumbered."""
    x = index.join(owned.select("cluster_id", *CELL), ["cluster_id", *CELL], "left_semi")
    pos = (F.row_number().over(Window.partitionBy("cluster_id", "dim").orderBy("cell_id")) - 1).cast("long")
    return x.select("cluster_id", "dim", pos.alias("pos"), "cell_id")


def output_map(partial: DataFrame) -> DataFrame:
    """Position among the predicted cells -> cell."""
    pos = (F.row_number().over(Window.partitionBy("cluster_id", "dim").orderBy("pos")) - 1).cast("long")
    return partial.filter("is_out").select("cluster_id", "dim", pos.alias("out_pos"), "cell_id")


def metropolis_weights(graph: DataFrame, clusters: DataFrame) -> DataFrame:
    """(src, dst, w): 1 / (1 + the larger degree) between neighbours, the rest of 1 for oneself; a cluster without
    neighbours has weight 1."""
    degree = graph.groupBy("src").agg(F.count("*").alias("degree"))
    x = graph.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("other")), "dst")
    w = x.select("src", "dst", (F.lit(1.0) / (1 + F.greatest("degree", "other"))).alias("w"))
    given = w.groupBy("src").agg(F.sum("w").alias("given"))
    own = clusters.select(F.col("cluster_id").alias("src")).distinct().join(given, "src", "left")
    return w.unionByName(own.select("src", F.col("src").alias("dst"), (1 - F.coalesce("given", F.lit(0.0))).alias("w")))


def global_agent(cells: DataFrame) -> DataFrame:
    """One agent that owns the whole complex, as an ownership table."""
    return cells.select(F.lit(0).cast("long").alias("cluster_id"), *CELL)


def project(whole: DataFrame, owned: DataFrame) -> DataFrame:
    """Values of the whole complex (dim, cell_id, ...) as the clusters' values of the cells they own (cluster_id first)."""
    return whole.join(owned.select("cluster_id", *CELL), CELL).select("cluster_id", *whole.columns)


def overlap_mean(local: DataFrame, cells: DataFrame, value: str = "x") -> DataFrame:
    """Mean over clusters' copies of each cell; 0 where no cluster has one. If ``cells`` has steps ``t``, of each step."""
    by = [*CELL, "t"] if "t" in cells.columns else CELL
    mean = local.groupBy(*by).agg(F.avg(value).alias(value))
    return cells.join(mean, by, "left").select(*by, F.coalesce(value, F.lit(0.0)).alias(value))


def in_equals_out_view(index: DataFrame, owned: DataFrame, boundaries: dict[int, DataFrame], signal: DataFrame, neighbours: DataFrame) -> dict[str, DataFrame]:
    """The view of agents that see no more than what they predict: ``index`` cut to predicted cells and renumbered, the
    ``complex`` and ``signal`` of these, and the ``neighbours`` maps (src, dst, dim, cell_id) less all other cells."""
    own = partial_indices(index, owned).filter("is_out").select("cluster_id", *CELL)
    cut = in_equals_out(index, own)
    return {"index": cut, "complex": local_complex(boundaries, cut), "signal": local_signal(signal, cut), "neighbours": only_local(neighbours, cut)}
