"""Partitioning a complex among agents: communities, ownership, interfaces, imports, elections and BFS clusters.

Ownership tables are (cluster_id, dim, cell_id). Set algebra on them is semi- and anti-joins; pairs of clusters come
from self-joins on a shared cell, never from a product of clusters.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobordia.operators import incidence as A
from cobordia.operators import neighbourhood as N
from cobordia.session import settle

CELL = ["dim", "cell_id"]


@dataclass(frozen=True)
class Partition:
    """The tables of a partition (module docstring); ``adjacency`` are the trees it was made with."""

    dim: int
    adjacency: DataFrame
    owned0: DataFrame
    interface: DataFrame
    owned: DataFrame
    agent_graph: DataFrame
    needs: DataFrame
    local_index: DataFrame


def check_dim(boundaries: N.Boundaries, dim: int) -> None:
    if not min(boundaries) - 1 <= dim <= max(boundaries):
        raise ValueError(f"dimension {dim} is out of range")


def only_edges(boundaries: N.Boundaries) -> dict[str, DataFrame]:
    """One agent per edge: what each owns, its (empty) interface, and what it needs: ``needs`` (src, dst, dim, cells,
    but) stands for all ``cells`` cells of the dimension, less one's own edge ``but``. ``needed`` lists those of given pairs."""
    if 1 not in boundaries and 2 not in boundaries:
        raise ValueError("an edge partition needs a boundary of dimension 1 or 2")
    edges = N.cells(boundaries).filter("dim = 1")
    owned = edges.select(F.col("cell_id").alias("cluster_id"), "dim", "cell_id")
    graph = N.edge_adjacency(boundaries).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    counts = {r["dim"]: r["n"] for r in N.cell_counts(N.cells(boundaries)).collect()}  # a row per dimension
    each = F.explode(F.array(*(F.struct(F.lit(d).cast("long").alias("dim"), F.lit(n - (d == 1)).cast("long").alias("cells")) for d, n in sorted(counts.items()))))
    needs = graph.select("src", "dst", each.alias("x")).select("src", "dst", "x.dim", "x.cells", F.when(F.col("x.dim") == 1, F.col("src")).alias("but"))
    return {"owned": owned, "interface": owned.limit(0), "agent_graph": graph, "needs": needs}


def needed(needs: DataFrame, boundaries: N.Boundaries) -> DataFrame:
    """(src, dst, dim, cell_id) of an edge partition's ``needs``, for the pairs wanted."""
    return needs.join(N.cells(boundaries), "dim").filter("but is null or but <> cell_id").select("src", "dst", "dim", "cell_id")


def modularity_score(graph: DataFrame, community: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Newman's modularity of a partition (cluster_id, cell_id) of an undirected graph (i, j), both directions given."""
    c = community.select(F.col("cell_id").alias("i"), F.col("cluster_id").alias("ci"))
    x = graph.join(c, "i").join(c.select(F.col("i").alias("j"), F.col("ci").alias("cj")), "j")
    each = x.groupBy("ci").agg(F.count("*").alias("degree"), F.sum(F.when(F.col("ci") == F.col("cj"), 1).otherwise(0)).alias("inside"))
    total = x.agg(F.count("*").alias("two_m"))
    part = F.col("inside") / F.col("two_m") - resolution * (F.col("degree") / F.col("two_m")) * (F.col("degree") / F.col("two_m"))
    return each.crossJoin(F.broadcast(total)).agg(F.sum(part).alias("modularity"))  # a one-row total


def greedy_modularity(graph: DataFrame, best_n: int | None = None, resolution: float = 1.0, most: int = 20_000_000) -> DataFrame:
    """Communities (cluster_id, cell_id) by greedy merging (Clauset, Newman and Moore) in one task per graph.

    The largest gain goes first, of equals the pair with the smallest members. Merging goes on while it loses nothing, and
    beyond that until ``best_n`` communities are left, if that is given; where only unlinked ones remain, the two largest
    are joined until no more than ``best_n`` are left. Communities are numbered by size (largest first), then smallest
    member.

    Every merge depends on the one before, so the graph (links only, no signal) is one task's; more than ``most`` rows of
    it are refused. Gains wait in a heap; those of the merged pair's neighbours are entered anew, older ones are skipped.
    """
    if graph.limit(most + 1).count() > most:
        raise ValueError(f"a graph of more than {most} links is too large for greedy merging; use hop_partition")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*pdf.i, *pdf.j})
        degree = {v: 0.0 for v in nodes}
        links: dict[int, dict[int, float]] = {v: {} for v in nodes}
        two_m = float(len(pdf))
        for i, j in zip(pdf.i, pdf.j, strict=True):
            degree[i] += 1
            if i != j:
                links[i][j] = links[i].get(j, 0.0) + 1
        member, age = {v: [v] for v in nodes}, dict.fromkeys(nodes, 0)

        def entry(a: int, b: int) -> tuple:
            a, b = min(a, b), max(a, b)
            return -2 * (links[a][b] / two_m - resolution * degree[a] * degree[b] / two_m**2), a, b, age[a], age[b]

        heap = [entry(a, b) for a in links for b in links[a] if a < b]
        heapq.heapify(heap)
        while heap and len(member) > 1:
            loss, a, b, age_a, age_b = heapq.heappop(heap)
            if a not in member or b not in member or (age[a], age[b]) != (age_a, age_b):
                continue
            if loss > 1e-12 and (best_n is None or len(member) <= best_n):
                break
            for c, w in links.pop(b).items():
                del links[c][b]
                if c != a:
                    links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
            degree[a] += degree.pop(b)
            member[a] += member.pop(b)
            age[a] += 1
            for c in links[a]:
                heapq.heappush(heap, entry(a, c))
        ranked = sorted(member.values(), key=lambda m: (-len(m), min(m)))
        while best_n is not None and len(ranked) > max(best_n, 1):
            ranked[:2] = [ranked[0] + ranked[1]]
        return pd.DataFrame([(k, v) for k, m in enumerate(ranked) for v in sorted(m)], columns=["cluster_id", "cell_id"])

    return graph.select(F.lit(0).alias("all"), "i", "j").groupBy("all").applyInPandas(lambda pdf: merge(pdf), "cluster_id long, cell_id long")


def partition(boundaries: N.Boundaries, community: DataFrame, dim: int = 1, q: int = 1, zero_diagonal: bool = False, near: DataFrame | None = None, like: Partition | None = None) -> Partition:
    """Ownership, interfaces and imports of the communities (cluster_id, cell_id) of ``dim``-cells. ``like``: the partition of
    these communities with imports from another distance, all else of which is taken over."""
    check_dim(boundaries, dim)
    boundaries = {k: settle(b) for k, b in boundaries.items()} if like is None else boundaries
    trees = settle(N.adjacency(boundaries)) if like is None else like.adjacency
    if near is None:
        hodge = A.hodge(boundaries, dim)
        near = N.self_adjacency(settle(hodge) if q > 1 else hodge, q, zero_diagonal)
    mine = community.select("cluster_id", F.lit(dim).cast("long").alias("dim"), "cell_id")
    other = trees.filter((F.col("dim_from") == dim) & (F.col("dim_to") != dim)).select(F.col("cell_from").alias("of"), F.col("dim_to").alias("dim"), F.col("cell_to").alias("cell_id"))
    if like is None:
        owned0 = mine.unionByName(community.select("cluster_id", F.col("cell_id").alias("of")).join(other, "of").select("cluster_id", *CELL).distinct())
        # every table below is used several times over; settled, none is computed twice
        owned0 = settle(owned0)
        interface = settle(shared(owned0.filter(F.col("dim") != dim)))
        owned = without_interface(owned0, interface, dim)
        graph = agent_graph(interface)
    else:
        owned0, interface, owned, graph = like.owned0, like.interface, like.owned, like.agent_graph
    asked = mine.select(F.col("cluster_id").alias("src"), F.col("cell_id").alias("i")).join(near, "i")
    asked = asked.join(mine.select(F.col("cluster_id").alias("dst"), F.col("cell_id").alias("j")), "j").filter("src <> dst")
    asked = asked.join(graph, ["src", "dst"], "left_semi").select("src", "dst", F.col("j").alias("cell_id")).distinct()
    beyond = asked.withColumnRenamed("cell_id", "of").join(other, "of").select("src", "dst", *CELL).distinct()
    beyond = beyond.join(owned.select(F.col("cluster_id").alias("dst"), *CELL), ["dst", *CELL], "left_semi").select("src", "dst", *CELL)
    needs = asked.select("src", "dst", F.lit(dim).cast("long").alias("dim"), "cell_id").unionByName(beyond)
    needs = settle(needs)
    return Partition(dim, trees, owned0, interface, owned, graph, needs, local_index(owned, interface, needs))


def shared(owned: DataFrame) -> DataFrame:
    """Cells that two clusters have: (c1, c2, dim, cell_id) with c1 < c2."""
    other = owned.withColumnRenamed("cluster_id", "c2")
    return owned.withColumnRenamed("cluster_id", "c1").join(other, CELL).filter("c1 < c2").select("c1", "c2", *CELL)


def without_interface(owned: DataFrame, interface: DataFrame, dim: int) -> DataFrame:
    """Owned cells less all interface cells: in other dimensions than ``dim``, what has one owner only."""
    return owned.join(interface.select(*CELL).distinct(), CELL, "left_anti").select("cluster_id", *CELL)


def both_ways(interface: DataFrame) -> DataFrame:
    """Per-neighbour view (src, dst, dim, cell_id) of the unordered interfaces."""
    one = interface.select(F.col("c1").alias("src"), F.col("c2").alias("dst"), *CELL)
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *CELL))


def agent_graph(interface: DataFrame) -> DataFrame:
    """Neighbouring clusters (src, dst), in both directions."""
    return both_ways(interface).select("src", "dst").distinct()


def local_index(owned: DataFrame, interface: DataFrame, needs: DataFrame) -> DataFrame:
    """(cluster_id, dim, pos, cell_id): all cells a cluster sees, numbered by cell_id."""
    seen = owned.unionByName(both_ways(interface).select(F.col("src").alias("cluster_id"), *CELL)).unionByName(needs.select(F.col("src").alias("cluster_id"), *CELL)).distinct()
    pos = (F.row_number().over(Window.partitionBy("cluster_id", "dim").orderBy("cell_id")) - 1).cast("long")
    return seen.select("cluster_id", "dim", pos.alias("pos"), "cell_id")


def local_complex(boundaries: N.Boundaries, index: DataFrame) -> DataFrame:
    """(cluster_id, dim, i, j, val): each boundary cut to the cells a cluster sees."""
    out = []
    for k, b in boundaries.items():
        rows = index.filter(F.col("dim") == k - 1).select("cluster_id", F.col("cell_id").alias("i"))
        columns = index.filter(F.col("dim") == k).select("cluster_id", F.col("cell_id").alias("j"))
        cut = b.join(columns, "j").join(rows, ["cluster_id", "i"], "left_semi")
        out.append(cut.select("cluster_id", F.lit(k).cast("long").alias("dim"), "i", "j", "val"))
    return reduce(DataFrame.unionByName, out)


def clusterheads(graph: DataFrame, nodes: DataFrame, d: int, score: Column | None = None, settle_every: int = 4) -> DataFrame:
    """Heads (node) by d rounds of neighbourhood maximum and d of minimum over (score, node): those whose own value
    comes back. ``graph``: (i, j); ``nodes``: (node, …), of which ``score`` is a column (the node by default)."""
    if d < 1:
        raise ValueError("d must be 1 or more")
    own = nodes.select("node", F.struct((score if score is not None else F.col("node")).alias("s"), F.col("node").alias("n")).alias("v"))
    won = own.withColumnRenamed("v", "w")
    # a node is in its own neighbourhood
    near = graph.filter("i <> j").select("i", "j").unionByName(nodes.select(F.col("node").alias("i"), F.col("node").alias("j")))
    for k in range(2 * d):
        best = F.max("w") if k < d else F.min("w")
        won = near.join(won.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node")).agg(best.alias("w"))
        if (k + 1) % settle_every == 0:
            won = settle(won)
    return won.join(own, "node").filter("w = v").select("node")


def bfs_clusters(graph: DataFrame, heads: DataFrame, d: int, score: DataFrame | None = None, settle_every: int = 4) -> DataFrame:
    """(node, head, parent, depth): nodes join heads over up to ``d`` hops, one hop a round; of several heads at one
    distance the smallest (score, head, parent) wins. ``score``: (node, s), the node itself by default."""
    if d < 1:
        raise ValueError("d must be 1 or more")
    if not heads.limit(1).count():
        raise ValueError("there are no heads")
    start = heads.select("node", F.col("node").alias("head"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"))
    score = score if score is not None else heads.select("node", F.col("node").alias("s"))
    done = start.join(score, "node").select("node", "head", "parent", "depth", "s")
    for k in range(1, d + 1):
        edge = done.filter(F.col("depth") == k - 1).select(F.col("node").alias("i"), "head", "s")
        offers = graph.filter("i <> j").join(edge, "i").join(done.select(F.col("node").alias("j")), "j", "left_anti")
        best = offers.groupBy("j").agg(F.min(F.struct("s", "head", F.col("i").alias("parent"))).alias("b"))
        done = done.unionByName(best.select(F.col("j").alias("node"), "b.head", "b.parent", F.lit(k).cast("long").alias("depth"), "b.s"))
        if k % settle_every == 0:
            done = settle(done)
    return done.select("node", "head", "parent", "depth")


def hop_partition(boundaries: N.Boundaries, d: int, dim: int = 1, q: int = 1) -> Partition:
    """Clusters of up to ``d`` hops on the full Hodge graph around elected heads, and their partition; powers are of
    the Laplacian without its diagonal. Imports are found before interface cells are taken from their owners."""
    check_dim(boundaries, dim)
    graph = settle(N.graph(A.hodge(boundaries, dim)))
    nodes = N.cells(boundaries).filter(F.col("dim") == dim).select(F.col("cell_id").alias("node"))
    found = settle(bfs_clusters(graph, clusterheads(graph, nodes, d), d))
    p = partition(boundaries, found.select(F.col("head").alias("cluster_id"), F.col("node").alias("cell_id")), dim, q, zero_diagonal=True)
    other = p.adjacency.filter((F.col("dim_from") == dim) & (F.col("dim_to") != dim)).select(F.col("cell_from").alias("of"), F.col("dim_to").alias("dim"), F.col("cell_to").alias("cell_id"))
    asked = p.needs.filter(F.col("dim") == dim)
    beyond = asked.select("src", "dst", F.col("cell_id").alias("of")).join(other, "of").select("src", "dst", *CELL).distinct()
    beyond = beyond.join(p.owned0.select(F.col("cluster_id").alias("dst"), *CELL), ["dst", *CELL], "left_semi").join(p.owned0.select(F.col("cluster_id").alias("src"), *CELL), ["src", *CELL], "left_anti")
    needs = asked.unionByName(beyond.select("src", "dst", *CELL))
    return Partition(dim, p.adjacency, p.owned0, p.interface, p.owned, p.agent_graph, needs, local_index(p.owned, p.interface, needs))


def centroids(index: DataFrame, places: DataFrame) -> DataFrame:
    """Mean position of each cluster's nodes; ``places``: (cell_id, lon, lat)."""
    return index.filter("dim = 0").join(places, "cell_id").groupBy("cluster_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def polygon_order(corners: DataFrame) -> DataFrame:
    """Corners (face_id, cell_id, lon, lat) of each polygon, numbered by their angle about its centre."""
    w = Window.partitionBy("face_id")
    angle = F.atan2(F.col("lat") - F.avg("lat").over(w), F.col("lon") - F.avg("lon").over(w))
    x = corners.withColumn("angle", angle)
    return x.select("face_id", "cell_id", (F.row_number().over(w.orderBy("angle", "cell_id")) - 1).cast("long").alias("pos"))
