"""The complex and signals that queries run on, derived from the driver's tables, as DataFrames and as DuckDB SQL.

Nodes are nations, edges pairs of nations with 1 <= v - u <= 3 (oriented u -> v), faces the triangles of that skeleton;
t is the month year * 12 + month of l_shipdate, counted from the first one. An edge's value is the net quantity shipped
between its nations (+ where the supplier's key is smaller), a node's the quantity its suppliers shipped, a face's the
boundary sum of its edges. All values are whole numbers. Communities of edges are the regions of their first nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.operators import features as X
from cobordia.operators import incidence as A
from cobordia.operators import partition as P
from cobordia.session import counted, settle, table

REACH = 3


class Fixture:
    """Lazy tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def _once(self, name: str, make) -> DataFrame:
        """Small tables that most queries use several times are settled when first asked for."""
        if name not in self._made:
            self._made[name] = settle(make())
        return self._made[name]

    def nodes(self) -> DataFrame:
        n = table(self.spark, self.dir, "nation")
        return n.select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("region_id"))

    def edges(self) -> DataFrame:
        return self._once("edges", self._edges)

    def _edges(self) -> DataFrame:
        u = self.nodes().select(F.col("node_id").alias("u"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(REACH).cast("long"))).alias("d"))
        pairs = u.select("u", (F.col("u") + F.col("d")).alias("v")).join(self.nodes().select(F.col("node_id").alias("v")), "v", "left_semi")
        return pairs.select((F.row_number().over(Window.orderBy("u", "v")) - 1).cast("long").alias("edge_id"), "u", "v")

    def faces(self) -> DataFrame:
        return self._once("faces", self._faces)

    def _faces(self) -> DataFrame:
        e = self.edges()
        ab, bc, ac = (e.select(F.col("edge_id").alias(n), F.col("u").alias(a), F.col("v").alias(b)) for n, a, b in (("ab", "a", "b"), ("bc", "b", "c"), ("ac", "a", "c")))
        x = ab.join(bc, "b").join(ac, ["a", "c"])
        return x.select((F.row_number().over(Window.orderBy("a", "b", "c")) - 1).cast("long").alias("face_id"), "ab", "bc", "ac")

    def boundary_1(self) -> DataFrame:
        e = self.edges()
        ends = F.explode(F.array(F.struct(F.col("u").alias("i"), F.lit(-1).cast("long").alias("val")), F.struct(F.col("v").alias("i"), F.lit(1).cast("long").alias("val")))).alias("x")
        return e.select(F.col("edge_id").alias("j"), ends).select("x.i", "j", "x.val")

    def boundary_2(self) -> DataFrame:
        sides = [F.struct(F.col(c).alias("i"), F.lit(s).cast("long").alias("val")) for c, s in (("ab", 1), ("bc", 1), ("ac", -1))]
        return self.faces().select(F.col("face_id").alias("j"), F.explode(F.array(*sides)).alias("x")).select("x.i", "j", "x.val")

    def boundaries(self) -> dict[int, DataFrame]:
        return {1: self.boundary_1(), 2: self.boundary_2()}

    def cells(self) -> DataFrame:
        parts = [(0, self.nodes(), "node_id"), (1, self.edges(), "edge_id"), (2, self.faces(), "face_id")]
        out = [d.select(F.lit(k).cast("long").alias("dim"), F.col(c).alias("cell_id")) for k, d, c in parts]
        return out[0].unionByName(out[1]).unionByName(out[2])

    def shipments(self) -> DataFrame:
        """(s, c, t, q): quantity from supplier to customer nation by month: nations squared times months, at most."""
        return self._once("shipments", self._shipments)

    def _shipments(self) -> DataFrame:
        li = table(self.spark, self.dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("t"))
        cust = table(self.spark, self.dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("c"))
        orders = table(self.spark, self.dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey")
        supp = table(self.spark, self.dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("s"))
        x = li.join(orders, "l_orderkey").join(supp, "l_suppkey").groupBy("s", "c", "t").agg(F.sum("l_quantity").alias("q"))
        return x.select("s", "c", "t", F.col("q").cast("long").alias("q"))

    def flows(self) -> DataFrame:
        """(edge_id, t, x) before the zero fill."""
        x = self.shipments().filter("s <> c").select(F.least("s", "c").alias("u"), F.greatest("s", "c").alias("v"), "t", F.when(F.col("s") < F.col("c"), F.col("q")).otherwise(-F.col("q")).alias("q"))
        return x.join(self.edges(), ["u", "v"]).groupBy("edge_id", "t").agg(F.sum("q").alias("x"))

    def months(self) -> DataFrame:
        """Months t with their numbers from 0."""
        return self._once("months", self._months)

    def _months(self) -> DataFrame:
        span = table(self.spark, self.dir, "lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
        first, last = F.year("a") * 12 + F.month("a"), F.year("b") * 12 + F.month("b")
        x = span.select(first.cast("long").alias("first"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("month"))
        return x.select("month", (F.col("month") - F.col("first")).alias("t"))

    def _filled(self, x: DataFrame, dim: int, key: str) -> DataFrame:
        x = x.withColumnRenamed("t", "month").join(counted(self.months()), "month").select(F.col(key).alias("cell_id"), "t", "x")
        cells = self.cells().filter(F.col("dim") == dim).select("cell_id")
        return X.fill(x, cells, self.months(), ["cell_id"]).select("cell_id", "t", "x")

    def edge_signal(self) -> DataFrame:
        return self._once("edge signal", lambda: self._filled(self.flows(), 1, "edge_id"))

    def node_signal(self) -> DataFrame:
        return self._once("node signal", lambda: self._filled(self.shipments().groupBy(F.col("s").alias("node_id"), "t").agg(F.sum("q").alias("x")), 0, "node_id"))

    def face_signal(self) -> DataFrame:
        return self._once("face signal", lambda: self._filled_face(A.apply(A.transpose(self.boundary_2()), self.edge_signal())))

    def _filled_face(self, x: DataFrame) -> DataFrame:
        cells = self.cells().filter("dim = 2").select("cell_id")
        return X.fill(x.withColumnRenamed("i", "cell_id"), cells, self.months(), ["cell_id"]).select("cell_id", "t", "x")

    def signal(self) -> DataFrame:
        """(dim, cell_id, t, x) of all three."""
        return self._once("signal", self._signal)

    def _signal(self) -> DataFrame:
        parts = [d.select(F.lit(k).cast("long").alias("dim"), "cell_id", "t", "x") for k, d in enumerate((self.node_signal(), self.edge_signal(), self.face_signal()))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def community(self) -> DataFrame:
        region = self.nodes().select(F.col("node_id").alias("u"), F.col("region_id").alias("cluster_id"))
        return self.edges().join(region, "u").select("cluster_id", F.col("edge_id").alias("cell_id"))

    def partition(self, q: int = 1) -> P.Partition:
        if f"partition {q}" not in self._made:
            self._made[f"partition {q}"] = P.partition(self.boundaries(), self.community(), 1, q)
        return self._made[f"partition {q}"]


#: The same tables in DuckDB SQL.
SQL = """
WITH nodes AS (SELECT n_nationkey::BIGINT AS node_id, n_regionkey::BIGINT AS region_id FROM nation),
edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a.node_id, b.node_id) - 1 AS edge_id, a.node_id AS u, b.node_id AS v FROM nodes a JOIN nodes b ON b.node_id - a.node_id BETWEEN 1 AND 3),
faces AS (SELECT row_number() OVER (ORDER BY x.u, x.v, y.v) - 1 AS face_id, x.edge_id AS ab, y.edge_id AS bc, z.edge_id AS ac FROM edges x JOIN edges y ON y.u = x.v JOIN edges z ON z.u = x.u AND z.v = y.v),
b1 AS MATERIALIZED (SELECT u AS i, edge_id AS j, -1::BIGINT AS val FROM edges UNION ALL SELECT v, edge_id, 1 FROM edges),
b2 AS MATERIALIZED (SELECT ab AS i, face_id AS j, 1::BIGINT AS val FROM faces UNION ALL SELECT bc, face_id, 1 FROM faces UNION ALL SELECT ac, face_id, -1 FROM faces),
cells AS (SELECT 0::BIGINT AS dim, node_id AS cell_id FROM nodes UNION ALL SELECT 1, edge_id FROM edges UNION ALL SELECT 2, face_id FROM faces),
l0 AS (SELECT a.i, b.i AS j, sum(a.val * b.val)::BIGINT AS val FROM b1 a JOIN b1 b ON a.j = b.j GROUP BY 1, 2 HAVING sum(a.val * b.val) <> 0),
l1l AS (SELECT a.j AS i, b.j, sum(a.val * b.val)::BIGINT AS val FROM b1 a JOIN b1 b ON a.i = b.i GROUP BY 1, 2 HAVING sum(a.val * b.val) <> 0),
l1u AS (SELECT a.i, b.i AS j, sum(a.val * b.val)::BIGINT AS val FROM b2 a JOIN b2 b ON a.j = b.j GROUP BY 1, 2 HAVING sum(a.val * b.val) <> 0),
l2 AS (SELECT a.j AS i, b.j, sum(a.val * b.val)::BIGINT AS val FROM b2 a JOIN b2 b ON a.i = b.i GROUP BY 1, 2 HAVING sum(a.val * b.val) <> 0),
h1 AS MATERIALIZED (SELECT i, j, sum(val)::BIGINT AS val FROM (SELECT * FROM l1l UNION ALL SELECT * FROM l1u) GROUP BY 1, 2 HAVING sum(val) <> 0),
h1z AS MATERIALIZED (SELECT * FROM h1 WHERE i <> j),
ship AS MATERIALIZED (SELECT s_nationkey::BIGINT AS s, c_nationkey::BIGINT AS c, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS month, sum(l_quantity)::BIGINT AS q
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
flows AS MATERIALIZED (SELECT edge_id, month, sum(CASE WHEN s < c THEN q ELSE -q END)::BIGINT AS x FROM ship JOIN edges ON least(s, c) = u AND greatest(s, c) = v WHERE s <> c GROUP BY 1, 2),
span AS (SELECT min(year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS a, max(year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS b FROM lineitem),
months AS (SELECT unnest(range(a, b + 1)) AS month, unnest(range(0, b - a + 1)) AS t FROM span),
s1 AS MATERIALIZED (SELECT e.edge_id AS cell_id, m.t, coalesce(f.x, 0)::BIGINT AS x FROM edges e CROSS JOIN months m LEFT JOIN flows f ON f.edge_id = e.edge_id AND f.month = m.month),
s0 AS MATERIALIZED (SELECT n.node_id AS cell_id, m.t, coalesce(f.x, 0)::BIGINT AS x FROM nodes n CROSS JOIN months m LEFT JOIN (SELECT s, month, sum(q) AS x FROM ship GROUP BY 1, 2) f ON f.s = n.node_id AND f.month = m.month),
s2 AS MATERIALIZED (SELECT j AS cell_id, t, sum(val * x)::BIGINT AS x FROM b2 JOIN s1 ON s1.cell_id = b2.i GROUP BY 1, 2),
signal AS MATERIALIZED (SELECT 0::BIGINT AS dim, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2),
community AS (SELECT region_id AS cluster_id, edge_id AS cell_id FROM edges JOIN nodes ON node_id = u),
adj AS MATERIALIZED (SELECT 1::BIGINT AS dim_from, j AS cell_from, 0::BIGINT AS dim_to, i AS cell_to FROM b1 UNION SELECT 0, i, 1, j FROM b1 UNION SELECT 2, j, 1, i FROM b2 UNION SELECT 1, i, 2, j FROM b2
  UNION SELECT 2, b2.j, 0, b1.i FROM b2 JOIN b1 ON b1.j = b2.i UNION SELECT 0, b1.i, 2, b2.j FROM b2 JOIN b1 ON b1.j = b2.i
  UNION SELECT 0, i, 0, j FROM l0 UNION SELECT 1, i, 1, j FROM h1 UNION SELECT 2, i, 2, j FROM l2),
owned0 AS MATERIALIZED (SELECT cluster_id, 1::BIGINT AS dim, cell_id FROM community UNION SELECT cluster_id, dim_to, cell_to FROM community JOIN adj ON dim_from = 1 AND cell_from = cell_id AND dim_to <> 1),
iface AS (SELECT a.cluster_id AS c1, b.cluster_id AS c2, a.dim, a.cell_id FROM owned0 a JOIN owned0 b ON a.dim = b.dim AND a.cell_id = b.cell_id AND a.cluster_id < b.cluster_id AND a.dim <> 1),
owned AS MATERIALIZED (SELECT * FROM owned0 o WHERE NOT EXISTS (SELECT 1 FROM iface f WHERE f.dim = o.dim AND f.cell_id = o.cell_id)),
iface2 AS MATERIALIZED (SELECT c1 AS src, c2 AS dst, dim, cell_id FROM iface UNION ALL SELECT c2, c1, dim, cell_id FROM iface),
agraph AS (SELECT DISTINCT src, dst FROM iface2),
need1 AS MATERIALIZED (SELECT DISTINCT a.cluster_id AS src, b.cluster_id AS dst, b.cell_id FROM community a JOIN h1z ON h1z.i = a.cell_id JOIN community b ON b.cell_id = h1z.j JOIN agraph g ON g.src = a.cluster_id AND g.dst = b.cluster_id WHERE a.cluster_id <> b.cluster_id),
need2 AS (SELECT DISTINCT src, dst, dim_to AS dim, cell_to AS cell_id FROM need1 JOIN adj ON dim_from = 1 AND cell_from = cell_id AND dim_to <> 1 WHERE (dst, dim_to, cell_to) IN (SELECT (cluster_id, dim, cell_id) FROM owned)),
needs AS MATERIALIZED (SELECT src, dst, 1::BIGINT AS dim, cell_id FROM need1 UNION ALL SELECT * FROM need2),
seen AS (SELECT * FROM owned UNION SELECT src, dim, cell_id FROM iface2 UNION SELECT src, dim, cell_id FROM needs),
lidx AS MATERIALIZED (SELECT cluster_id, dim, row_number() OVER (PARTITION BY cluster_id, dim ORDER BY cell_id) - 1 AS pos, cell_id FROM seen),
deg AS (SELECT src, count(*) AS degree FROM agraph GROUP BY src),
wn AS (SELECT g.src, g.dst, 1.0::DOUBLE / (1 + greatest(a.degree, b.degree)) AS w FROM agraph g JOIN deg a ON a.src = g.src JOIN deg b ON b.src = g.dst),
mhw AS (SELECT * FROM wn UNION ALL SELECT c.cluster_id, c.cluster_id, 1 - coalesce(sum(w), 0) FROM (SELECT DISTINCT cluster_id FROM community) c LEFT JOIN wn ON wn.src = c.cluster_id GROUP BY 1, 2)
"""
