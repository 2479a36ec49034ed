"""Queries on the complex itself and its partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobordia.operators import agents as G
from cobordia.operators import incidence as A
from cobordia.operators import neighbourhood as N
from cobordia.operators import partition as P
from cobordia.plans.fixture import SQL as BASE
from cobordia.plans.fixture import Fixture

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register ``f(fixture)`` as query ``name``, with the SQL that follows the fixture's tables."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql:
            SQL[name] = BASE.replace("WITH nodes", "WITH RECURSIVE nodes") + sql if "RECURSIVE" in sql else BASE + sql
        return f

    return put


def _entries(d: DataFrame) -> DataFrame:
    return d.select("i", "j", "val")


query("cells", "SELECT * FROM cells")(lambda x: x.cells())
query("cell_counts", "SELECT dim, count(*) AS n FROM cells GROUP BY dim")(lambda x: N.cell_counts(x.cells()))
query("edges", "SELECT * FROM edges")(lambda x: x.edges())
query("faces", "SELECT * FROM faces")(lambda x: x.faces())
query("boundary_1", "SELECT * FROM b1")(lambda x: x.boundary_1())
query("boundary_2", "SELECT * FROM b2")(lambda x: x.boundary_2())
query("boundary_check", "SELECT count(*) AS nonzero FROM (SELECT b1.i, b2.j FROM b1 JOIN b2 ON b1.j = b2.i GROUP BY 1, 2 HAVING sum(b1.val * b2.val) <> 0)")(lambda x: N.boundary_of_boundary(x.boundary_1(), x.boundary_2()))
query("laplacian_0_upper", "SELECT * FROM l0")(lambda x: A.upper_laplacian(x.boundary_1()))
query("laplacian_1_lower", "SELECT * FROM l1l")(lambda x: A.lower_laplacian(x.boundary_1()))
query("laplacian_1_upper", "SELECT * FROM l1u")(lambda x: A.upper_laplacian(x.boundary_2()))
query("laplacian_2_lower", "SELECT * FROM l2")(lambda x: A.lower_laplacian(x.boundary_2()))
query("hodge_1", "SELECT * FROM h1")(lambda x: A.hodge(x.boundaries(), 1))

_SQUARE = "SELECT a.i, b.j, sum(a.val * b.val)::BIGINT AS val FROM {m} a JOIN {m} b ON a.j = b.i GROUP BY 1, 2 HAVING sum(a.val * b.val) <> 0"
query("hodge_power_2", _SQUARE.format(m="h1"))(lambda x: A.power(A.hodge(x.boundaries(), 1), 2))
query("lower_powers", f", p2 AS ({_SQUARE.format(m='l1l')}) SELECT 1::BIGINT AS k, * FROM l1l UNION ALL SELECT 2, * FROM p2")(lambda x: A.powers(A.lower_laplacian(x.boundary_1()), 2))
query("lower_powers_to_nodes", f", p2 AS ({_SQUARE.format(m='l1l')}), p AS (SELECT 1::BIGINT AS k, * FROM l1l UNION ALL SELECT 2, * FROM p2) SELECT k, p.i, b1.i AS j, sum(p.val * b1.val)::BIGINT AS val FROM p JOIN b1 ON b1.j = p.j GROUP BY 1, 2, 3 HAVING sum(p.val * b1.val) <> 0")(
    lambda x: A.each_times(A.powers(A.lower_laplacian(x.boundary_1()), 2), A.transpose(x.boundary_1()))
)
query("laplacian_signal", "SELECT i, t, sum(val * x)::BIGINT AS x FROM l1l JOIN s1 ON s1.cell_id = l1l.j GROUP BY 1, 2")(lambda x: A.apply(A.lower_laplacian(x.boundary_1()), x.edge_signal()))
query("qhop_adjacency_1", "SELECT i, j FROM h1z")(lambda x: N.self_adjacency(A.hodge(x.boundaries(), 1), 1))
query("qhop_adjacency_2", f"SELECT i, j FROM ({_SQUARE.format(m='h1')}) WHERE i <> j")(lambda x: N.self_adjacency(A.hodge(x.boundaries(), 1), 2))
query("qhop_zero_diagonal", f"SELECT i, j FROM ({_SQUARE.format(m='h1z')}) WHERE i <> j")(lambda x: N.self_adjacency(A.hodge(x.boundaries(), 1), 2, zero_diagonal=True))
query("edge_adjacency", "SELECT i, j FROM h1z")(lambda x: N.edge_adjacency(x.boundaries()))
query("laplacian_graph", "SELECT i, j FROM l1l WHERE i <> j")(lambda x: N.graph(A.lower_laplacian(x.boundary_1())))
query("adjacency_down", "SELECT * FROM adj WHERE dim_to < dim_from")(lambda x: N.adjacency(x.boundaries()).filter("dim_to < dim_from"))
query("adjacency_up", "SELECT * FROM adj WHERE dim_to > dim_from")(lambda x: N.adjacency(x.boundaries()).filter("dim_to > dim_from"))
query("adjacency_self", "SELECT * FROM adj WHERE dim_to = dim_from")(lambda x: N.adjacency(x.boundaries()).filter("dim_to = dim_from"))
query("adjacency_faces_cofaces", "SELECT cell_from, dim_to, cell_to FROM adj WHERE dim_from = 1 AND dim_to <> 1")(
    lambda x: N.adjacency(x.boundaries(), own=False).filter("dim_from = 1").select("cell_from", "dim_to", "cell_to")
)
query("self_adjacent_cluster", "SELECT DISTINCT cluster_id, h1z.j AS cell_id FROM community JOIN h1z ON h1z.i = cell_id")(lambda x: N.reached(x.community(), N.self_adjacency(A.hodge(x.boundaries(), 1), 1)))
query("submatrix_region", "SELECT h1.* FROM h1 WHERE i IN (SELECT cell_id FROM community WHERE cluster_id = 1) AND j IN (SELECT cell_id FROM community WHERE cluster_id = 1)")(
    lambda x: A.submatrix(A.hodge(x.boundaries(), 1), c := x.community().filter("cluster_id = 1").select("cell_id"), c)
)
query("smoothing_matrix", "SELECT i, j, sum(val) AS val FROM (SELECT edge_id AS i, edge_id AS j, 1.0::DOUBLE AS val FROM edges UNION ALL SELECT i, j, val * 0.5::DOUBLE FROM l1l UNION ALL SELECT i, j, val * 0.25::DOUBLE FROM l1u) GROUP BY 1, 2 HAVING sum(val) <> 0")(
    lambda x: A.smoothing(x.edges().select("edge_id"), A.lower_laplacian(x.boundary_1()), A.upper_laplacian(x.boundary_2()), 0.5, 0.25)
)

query("only_edges_owned", "SELECT edge_id AS cluster_id, 1::BIGINT AS dim, edge_id AS cell_id FROM edges")(lambda x: P.only_edges(x.boundaries())["owned"])
query("only_edges_needs", "SELECT i AS src, j AS dst, dim, count(*) AS cells FROM h1z JOIN cells ON dim <> 1 OR cell_id <> i GROUP BY 1, 2, 3")(lambda x: P.only_edges(x.boundaries())["needs"].select("src", "dst", "dim", "cells"))
query("owned0", "SELECT * FROM owned0")(lambda x: x.partition().owned0)
query("interface", "SELECT * FROM iface")(lambda x: x.partition().interface)
query("owned", "SELECT * FROM owned")(lambda x: x.partition().owned)
query("agent_graph", "SELECT * FROM agraph")(lambda x: x.partition().agent_graph)
query("needs_requested", "SELECT * FROM needs WHERE dim = 1")(lambda x: x.partition().needs.filter("dim = 1"))
query("needs_other", "SELECT * FROM needs WHERE dim <> 1")(lambda x: x.partition().needs.filter("dim <> 1"))
query("local_index", "SELECT * FROM lidx")(lambda x: x.partition().local_index)
query("local_complex", "SELECT c.cluster_id, 1::BIGINT AS dim, b1.i, b1.j, b1.val FROM b1 JOIN lidx c ON c.dim = 1 AND c.cell_id = b1.j JOIN lidx r ON r.dim = 0 AND r.cell_id = b1.i AND r.cluster_id = c.cluster_id UNION ALL SELECT c.cluster_id, 2, b2.i, b2.j, b2.val FROM b2 JOIN lidx c ON c.dim = 2 AND c.cell_id = b2.j JOIN lidx r ON r.dim = 1 AND r.cell_id = b2.i AND r.cluster_id = c.cluster_id")(
    lambda x: P.local_complex(x.boundaries(), x.partition().local_index)
)
query("local_signal", "SELECT cluster_id, l.dim, l.cell_id, t, x FROM lidx l JOIN signal s ON s.dim = l.dim AND s.cell_id = l.cell_id")(lambda x: G.local_signal(x.signal(), x.partition().local_index))
query("pure_local_signal", "SELECT cluster_id, l.dim, l.cell_id, t, x FROM owned l JOIN signal s ON s.dim = l.dim AND s.cell_id = l.cell_id")(lambda x: G.local_signal(x.signal(), x.partition().owned))
_PARTIAL = ", part AS (SELECT l.cluster_id, l.dim, l.pos, l.cell_id, (o.cell_id IS NOT NULL OR count(o.cell_id) OVER (PARTITION BY l.cluster_id, l.dim) = 0) AS is_out FROM lidx l LEFT JOIN owned o ON o.cluster_id = l.cluster_id AND o.dim = l.dim AND o.cell_id = l.cell_id) "
query("partial_indices", _PARTIAL + "SELECT * FROM part")(lambda x: G.partial_indices((p := x.partition()).local_index, p.owned))
query("output_map", _PARTIAL + "SELECT cluster_id, dim, row_number() OVER (PARTITION BY cluster_id, dim ORDER BY pos) - 1 AS out_pos, cell_id FROM part WHERE is_out")(lambda x: G.output_map(G.partial_indices((p := x.partition()).local_index, p.owned)))
query("neighbour_interface", "SELECT * FROM iface2")(lambda x: G.neighbour_interface(x.partition().interface))
query("imports_of_1", "SELECT dst AS neighbour, dim, cell_id FROM needs WHERE src = 1")(lambda x: G.imports(x.partition().needs, 1))
query("exports_of_1", "SELECT src AS neighbour, dim, cell_id FROM needs WHERE dst = 1")(lambda x: G.exports(x.partition().needs, 1))
query("in_equals_out", "SELECT l.cluster_id, l.dim, row_number() OVER (PARTITION BY l.cluster_id, l.dim ORDER BY l.cell_id) - 1 AS pos, l.cell_id FROM lidx l JOIN owned o ON o.cluster_id = l.cluster_id AND o.dim = l.dim AND o.cell_id = l.cell_id")(
    lambda x: G.in_equals_out((p := x.partition()).local_index, p.owned)
)
query("only_local_neighbours", "SELECT n.* FROM needs n JOIN owned o ON o.cluster_id = n.src AND o.dim = n.dim AND o.cell_id = n.cell_id UNION ALL SELECT n.* FROM needs n JOIN owned o ON o.cluster_id = n.dst AND o.dim = n.dim AND o.cell_id = n.cell_id")(
    lambda x: (lambda p: G.only_local(p.needs, p.owned).unionByName(G.only_local(p.needs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dim", "cell_id"), p.owned).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dim", "cell_id")))(x.partition())
)
query("mh_weights", "SELECT * FROM mhw")(lambda x: G.metropolis_weights(x.partition().agent_graph, x.community()).withColumn("w", F.col("w")))
query("in_equals_out_complex", ", own AS (SELECT * FROM owned), cut AS (SELECT l.cluster_id, l.dim, l.cell_id FROM lidx l JOIN own o ON o.cluster_id = l.cluster_id AND o.dim = l.dim AND o.cell_id = l.cell_id UNION SELECT l.cluster_id, l.dim, l.cell_id FROM lidx l WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.cluster_id = l.cluster_id AND o.dim = l.dim)) SELECT c.cluster_id, 1::BIGINT AS dim, b1.i, b1.j, b1.val FROM b1 JOIN cut c ON c.dim = 1 AND c.cell_id = b1.j JOIN cut r ON r.dim = 0 AND r.cell_id = b1.i AND r.cluster_id = c.cluster_id UNION ALL SELECT c.cluster_id, 2, b2.i, b2.j, b2.val FROM b2 JOIN cut c ON c.dim = 2 AND c.cell_id = b2.j JOIN cut r ON r.dim = 1 AND r.cell_id = b2.i AND r.cluster_id = c.cluster_id")(
    lambda x: (lambda p: G.in_equals_out_view(p.local_index, p.owned, x.boundaries(), x.signal(), p.needs)["complex"])(x.partition())
)
query("in_equals_out_signal", "SELECT l.cluster_id, l.dim, l.cell_id, t, x FROM lidx l JOIN signal s ON s.dim = l.dim AND s.cell_id = l.cell_id WHERE EXISTS (SELECT 1 FROM owned o WHERE o.cluster_id = l.cluster_id AND o.dim = l.dim AND o.cell_id = l.cell_id) OR NOT EXISTS (SELECT 1 FROM owned o WHERE o.cluster_id = l.cluster_id AND o.dim = l.dim)")(
    lambda x: (lambda p: G.in_equals_out_view(p.local_index, p.owned, x.boundaries(), x.signal(), p.needs)["signal"])(x.partition())
)
query("global_agent", "SELECT 0::BIGINT AS cluster_id, dim, cell_id FROM cells")(lambda x: G.global_agent(x.cells()))
query("overlap_mean", "SELECT s.dim, s.cell_id, s.t, coalesce(avg(s.x * l.cluster_id), 0.0)::DOUBLE AS x FROM signal s LEFT JOIN owned0 l ON l.dim = s.dim AND l.cell_id = s.cell_id GROUP BY 1, 2, 3")(
    lambda x: G.overlap_mean(G.local_signal(x.signal(), x.partition().owned0).withColumn("x", F.col("x") * F.col("cluster_id")), x.signal().select("dim", "cell_id", "t"))
)
query("centroids", "SELECT cluster_id, avg(region_id) AS lon, avg(node_id) AS lat FROM lidx JOIN nodes ON node_id = cell_id WHERE dim = 0 GROUP BY 1")(lambda x: P.centroids(x.partition().local_index, x.nodes().select(F.col("node_id").alias("cell_id"), F.col("region_id").alias("lon"), F.col("node_id").alias("lat"))))
query("polygon_order", ", c AS (SELECT DISTINCT b2.j AS face_id, b1.i AS cell_id FROM b2 JOIN b1 ON b1.j = b2.i), p AS (SELECT face_id, cell_id, atan2(cell_id - avg(cell_id) OVER (PARTITION BY face_id), cell_id % 5 - avg(cell_id % 5) OVER (PARTITION BY face_id)) AS angle FROM c) SELECT face_id, cell_id, row_number() OVER (PARTITION BY face_id ORDER BY angle, cell_id) - 1 AS pos FROM p")(
    lambda x: P.polygon_order(N.below(x.boundaries(), 2, 2).select(F.col("cell_from").alias("face_id"), F.col("cell_to").alias("cell_id"), (F.col("cell_to") % 5).alias("lon"), F.col("cell_to").alias("lat")))
)
query("modularity_score", ", d AS (SELECT ci, count(*) AS degree, count(*) FILTER (ci = cj) AS inside FROM (SELECT a.cluster_id AS ci, b.cluster_id AS cj FROM l1l g JOIN community a ON a.cell_id = g.i JOIN community b ON b.cell_id = g.j WHERE g.i <> g.j) GROUP BY ci), m AS (SELECT sum(degree) AS two_m FROM d) SELECT round(sum(inside / two_m - (degree / two_m) * (degree / two_m)), 9) AS modularity FROM d, m")(
    lambda x: P.modularity_score(N.graph(A.lower_laplacian(x.boundary_1())), x.community()).select(F.round("modularity", 9).alias("modularity"))
)
query("modularity_clusters")(lambda x: P.greedy_modularity(N.graph(A.lower_laplacian(x.boundary_1())), 7, 1.5))


def _rounds(d: int) -> str:
    """Max-min rounds over the edge graph, unrolled; scores are the edge ids."""
    near = ", near AS (SELECT i, j FROM h1z UNION SELECT edge_id, edge_id FROM edges), w0 AS (SELECT edge_id AS node, edge_id AS w FROM edges)"
    for k in range(2 * d):
        near += f", w{k + 1} AS (SELECT i AS node, {'max' if k < d else 'min'}(w) AS w FROM near JOIN w{k} ON node = j GROUP BY i)"
    return near + f", heads AS (SELECT node FROM w{2 * d} WHERE w = node)"


def _heads(x: Fixture, d: int) -> DataFrame:
    return P.clusterheads(N.edge_adjacency(x.boundaries()), x.edges().select(F.col("edge_id").alias("node")), d)


query("clusterheads_d1", _rounds(1) + " SELECT node FROM heads")(lambda x: _heads(x, 1))
query("clusterheads_d2", _rounds(2) + " SELECT node FROM heads")(lambda x: _heads(x, 2))
_BFS = ", g0 AS (SELECT node, node AS head, NULL::BIGINT AS parent, 0::BIGINT AS depth FROM heads)" + "".join(
    f", o{k} AS (SELECT j AS node, min([head, i]) AS b FROM h1z JOIN g{k - 1} ON node = i AND depth = {k - 1} WHERE j NOT IN (SELECT node FROM g{k - 1}) GROUP BY j), g{k} AS (SELECT * FROM g{k - 1} UNION ALL SELECT node, b[1], b[2], {k} FROM o{k})" for k in (1, 2)
)
query("bfs_clusters_d2", _rounds(2) + _BFS + " SELECT node, head, coalesce(parent, -1) AS parent, depth FROM g2")(lambda x: P.bfs_clusters(N.edge_adjacency(x.boundaries()), _heads(x, 2), 2).na.fill({"parent": -1}))
_HOP = _rounds(2) + _BFS + """, hc AS (SELECT head AS cluster_id, node AS cell_id FROM g2), ho AS (SELECT cluster_id, 1::BIGINT AS dim, cell_id FROM hc UNION SELECT cluster_id, dim_to, cell_to FROM hc JOIN adj ON dim_from = 1 AND cell_from = cell_id AND dim_to <> 1),
hi AS (SELECT a.cluster_id AS c1, b.cluster_id AS c2, a.dim, a.cell_id FROM ho a JOIN ho b ON a.dim = b.dim AND a.cell_id = b.cell_id AND a.cluster_id < b.cluster_id AND a.dim <> 1),
hg AS (SELECT c1 AS src, c2 AS dst FROM hi UNION SELECT c2, c1 FROM hi)"""
query("hop_partition_owned", _HOP + " SELECT * FROM ho o WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.dim = o.dim AND hi.cell_id = o.cell_id)")(lambda x: P.hop_partition(x.boundaries(), 2).owned)
query(
    "hop_partition_needs",
    _HOP + f""", near2 AS (SELECT i, j FROM ({_SQUARE.format(m='h1z')}) WHERE i <> j),
hn AS (SELECT DISTINCT a.cluster_id AS src, b.cluster_id AS dst, b.cell_id FROM hc a JOIN near2 ON near2.i = a.cell_id JOIN hc b ON b.cell_id = near2.j JOIN hg ON hg.src = a.cluster_id AND hg.dst = b.cluster_id)
SELECT src, dst, 1::BIGINT AS dim, cell_id FROM hn UNION ALL SELECT * FROM (SELECT DISTINCT src, dst, dim_to AS dim, cell_to AS cell_id FROM hn JOIN adj ON dim_from = 1 AND cell_from = cell_id AND dim_to <> 1) n
WHERE (dst, dim, cell_id) IN (SELECT (cluster_id, dim, cell_id) FROM ho) AND (src, dim, cell_id) NOT IN (SELECT (cluster_id, dim, cell_id) FROM ho)""",
)(lambda x: P.hop_partition(x.boundaries(), 2, q=2).needs)
