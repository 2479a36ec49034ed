"""Queries on signals, features, exchange, mixing and metrics that need no learning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobordia.operators import agents as G
from cobordia.operators import consensus as C
from cobordia.operators import exchange as E
from cobordia.operators import features as X
from cobordia.operators import incidence as A
from cobordia.operators import learning as L
from cobordia.operators import metrics as M
from cobordia.operators import partition as P
from cobordia.plans.fixture import SQL as BASE
from cobordia.plans.fixture import Fixture
from cobordia.session import counted, settle

QUERIES, SQL = {}, {}
GAMMA = 0.5


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql:
            SQL[name] = BASE + sql
        return f

    return put


def _round(d: DataFrame, *columns: str) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c in columns})


# ---- signals
query("edge_flows", "SELECT edge_id, month AS t, x FROM flows")(lambda f: f.flows())
query("edge_signal", "SELECT * FROM s1")(lambda f: f.edge_signal())
query("face_signal", "SELECT * FROM s2")(lambda f: f.face_signal())
query("centered_signal", "SELECT dim, cell_id, t, round(x - avg(x) OVER (PARTITION BY dim), 6) AS x FROM signal")(lambda f: _round(X.centre(f.signal()), "x"))
query("zero_signal", "SELECT dim, cell_id, t, 0.0::DOUBLE AS x FROM cells, (SELECT unnest(range(0, 12)) AS t)")(lambda f: X.zero_signal(f.cells(), 12))
query("signal_steps", "SELECT min(t) + 1 AS steps FROM (SELECT dim, max(t) AS t FROM signal GROUP BY dim)")(lambda f: X.steps(f.signal()))
query("snapshot", "SELECT * FROM signal WHERE t = 5")(lambda f: X.snapshot(f.signal(), 5))
query("appended_signal", "SELECT * FROM signal UNION ALL SELECT dim, cell_id, (SELECT max(t) FROM signal) + 1 AS t, x FROM signal WHERE t = 3")(lambda f: X.append(f.signal(), X.snapshot(f.signal(), 3).drop("t")))
query("partial_snapshot", "SELECT cluster_id, l.dim, l.cell_id, s.t, s.x FROM lidx l JOIN signal s USING (dim, cell_id) WHERE s.t = 7")(lambda f: G.local_signal(X.snapshot(f.signal(), 7), f.partition().local_index))
query("lag_buffer", "SELECT cell_id, t, lag, coalesce(lag(x, lag::INT) OVER (PARTITION BY cell_id, lag ORDER BY t), 0)::BIGINT AS x FROM s1, (VALUES (1::BIGINT), (2), (3)) v(lag)")(lambda f: X.lags(f.edge_signal(), 3))

# ---- features
_LAGS = ", lags AS (SELECT cell_id, t, lag, coalesce(lag(x, lag::INT) OVER (PARTITION BY cell_id, lag ORDER BY t), 0)::BIGINT AS x FROM {s}, (VALUES (0::BIGINT), (1), (2)) v(lag))"
_POWERS = """, lp AS (SELECT 1::BIGINT AS k, * FROM l1l UNION ALL SELECT 2, a.i, b.j, sum(a.val * b.val)::BIGINT FROM l1l a JOIN l1l b ON a.j = b.i GROUP BY 1, 2, 3),
up AS (SELECT 1::BIGINT AS k, * FROM l1u UNION ALL SELECT 2, a.i, b.j, sum(a.val * b.val)::BIGINT FROM l1u a JOIN l1u b ON a.j = b.i GROUP BY 1, 2, 3)"""
query(
    "topolms_features",
    _LAGS.format(s="s1") + _POWERS + """ SELECT i, t, (2 - k)::BIGINT AS f, sum(val * x)::BIGINT AS s FROM up JOIN lags ON cell_id = j AND lag = k GROUP BY 1, 2, 3
UNION ALL SELECT cell_id, t, 2, x FROM s1
UNION ALL SELECT i, t, (5 - k)::BIGINT, sum(val * x)::BIGINT FROM lp JOIN lags ON cell_id = j AND lag = k - 1 GROUP BY 1, 2, 3""",
)(lambda f: X.topolms(settle(A.lower_laplacian(f.boundary_1())), settle(A.upper_laplacian(f.boundary_2())), f.edge_signal(), 2))


def _edge_features(f: Fixture) -> DataFrame:
    lower, upper = settle(A.lower_laplacian(f.boundary_1())), settle(A.upper_laplacian(f.boundary_2()))  # each used in two blocks
    return X.ccvar(f.edges().select("edge_id"), f.edge_signal(), lower, upper, (2, 2), 2, (f.boundary_1(), f.node_signal(), 2), (f.boundary_2(), f.face_signal(), 2))


_EDGE = (
    _POWERS
    + "".join(f", g{k} AS (SELECT cell_id, t, lag, coalesce(lag(x, lag::INT) OVER (PARTITION BY cell_id, lag ORDER BY t), 0)::BIGINT AS x FROM s{k}, (VALUES (1::BIGINT), (2)) v(lag))" for k in (0, 1, 2))
    + """, lb AS (SELECT k, lp.i, b1.i AS j, sum(lp.val * b1.val)::BIGINT AS val FROM lp JOIN b1 ON b1.j = lp.j GROUP BY 1, 2, 3),
ub AS (SELECT k, up.i, b2.j, sum(up.val * b2.val)::BIGINT AS val FROM up JOIN b2 ON b2.i = up.j GROUP BY 1, 2, 3 HAVING sum(up.val * b2.val) <> 0),
feat AS MATERIALIZED (SELECT i, t, 'l' AS block, k, lag, sum(val * x)::DOUBLE AS s FROM (SELECT * FROM lb WHERE val <> 0) JOIN g0 ON cell_id = j GROUP BY ALL
UNION ALL SELECT i, t, 'sl', k, lag, sum(val * x)::DOUBLE FROM (SELECT * FROM lp WHERE val <> 0) JOIN g1 ON cell_id = j GROUP BY ALL
UNION ALL SELECT i, t, 'su', k, lag, sum(val * x)::DOUBLE FROM (SELECT * FROM up WHERE val <> 0) JOIN g1 ON cell_id = j GROUP BY ALL
UNION ALL SELECT i, t, 'u', k, lag, sum(val * x)::DOUBLE FROM ub JOIN g2 ON cell_id = j GROUP BY ALL
UNION ALL SELECT edge_id, t, 'b', 0, 0, 1.0 FROM edges, months),
cols AS (SELECT block, k, lag, row_number() OVER (ORDER BY list_position(['l', 'sl', 'su', 'u', 'b'], block), k, lag) - 1 AS f FROM (SELECT DISTINCT block, k, lag FROM feat)),
nf AS MATERIALIZED (SELECT i, t, f, s FROM feat JOIN cols USING (block, k, lag))"""
)
query("ccvar_features_edge", _EDGE + " SELECT * FROM feat")(_edge_features)
query(
    "ccvar_features_node",
    ", g AS (SELECT cell_id, t, lag, coalesce(lag(x, lag::INT) OVER (PARTITION BY cell_id, lag ORDER BY t), 0)::BIGINT AS x FROM s0, (VALUES (1::BIGINT), (2)) v(lag)), p AS (SELECT 1::BIGINT AS k, * FROM l0 UNION ALL SELECT 2, a.i, b.j, sum(a.val * b.val)::BIGINT FROM l0 a JOIN l0 b ON a.j = b.i GROUP BY 1, 2, 3) SELECT i, t, 'su' AS block, k, lag, sum(val * x)::DOUBLE AS s FROM p JOIN g ON cell_id = j WHERE val <> 0 GROUP BY ALL",
)(lambda f: X.ccvar(f.nodes().select("node_id"), f.node_signal(), None, A.upper_laplacian(f.boundary_1()), (2, 2), 2, bias=False))
query("ccvar_columns", _EDGE + " SELECT block, count(*) AS columns FROM cols GROUP BY block")(lambda f: _edge_features(f).select("block", "k", "lag").distinct().groupBy("block").agg(F.count("*").alias("columns")))
query(
    "feature_normalized",
    _EDGE + ", sc AS (SELECT t, sqrt(sum(x * x)) AS scale FROM g1 WHERE lag = 1 GROUP BY t) SELECT i, t, block, k, lag, round(s / sqrt(CASE WHEN q = 0 THEN 0.001 ELSE q END) * scale, 6) AS s FROM (SELECT *, sum(s * s) OVER (PARTITION BY t, block, k, lag) AS q FROM feat) JOIN sc USING (t)",
)(lambda f: _round(X.normalise(_edge_features(f), f.edge_signal()), "s"))
_GRAM = ", gm AS (SELECT a.t, a.f, b.f AS g, sum(a.s * b.s) AS val FROM nf a JOIN nf b USING (i, t) GROUP BY 1, 2, 3)"
query("gram_rhs", _EDGE + _GRAM + " SELECT t, f, g, val FROM gm UNION ALL SELECT t, f, -1, sum(s * x)::DOUBLE FROM nf JOIN s1 USING (t) WHERE s1.cell_id = nf.i GROUP BY 1, 2")(
    lambda f: (lambda n: X.gram(n).select("t", "f", "g", "val").unionByName(X.right_hand_side(n, f.edge_signal()).select("t", "f", F.lit(-1).cast("long").alias("g"), "val")))(settle(X.numbered(_edge_features(f))))
)
query(
    "spectral_norm",
    _EDGE + _GRAM + """, p(k, t, f, g, val) AS (
  SELECT 0, t, f, g, val / (SELECT sum(b.val) FROM gm b WHERE b.t = gm.t AND b.f = b.g) FROM gm WHERE t IN (SELECT t FROM gm WHERE f = g GROUP BY t HAVING sum(val) > 0)
  UNION ALL
  SELECT k, t, f, g, val / sum(CASE WHEN f = g THEN val END) OVER (PARTITION BY t) FROM (SELECT a.k + 1 AS k, a.t, a.f, b.g, sum(a.val * b.val) AS val FROM p a JOIN p b ON a.t = b.t AND a.g = b.f WHERE a.k < 26 GROUP BY 1, 2, 3, 4))
SELECT t, round(ln(sum(gm.val * p.val)), 6) AS log_norm2 FROM gm JOIN p USING (t, f, g) WHERE k = 26 GROUP BY t""",
)(lambda f: L.spectral_norm(X.gram(settle(X.numbered(_edge_features(f)))), ["t"]).filter("norm2 > 0").select("t", F.round(F.log("norm2"), 6).alias("log_norm2")))
SQL["spectral_norm"] = SQL["spectral_norm"].replace("WITH nodes", "WITH RECURSIVE nodes", 1)
query(
    "smoothed_gram",
    _EDGE + ", r AS (SELECT i, j, sum(val) AS val FROM (SELECT edge_id AS i, edge_id AS j, 1.0::DOUBLE AS val FROM edges UNION ALL SELECT i, j, val * 0.5::DOUBLE FROM l1l) GROUP BY 1, 2) SELECT a.t, a.f, b.f AS g, sum(a.s * r.val * b.s) AS val FROM nf a JOIN r ON r.i = a.i JOIN nf b ON b.i = r.j AND b.t = a.t GROUP BY 1, 2, 3",
)(lambda f: X.gram(settle(X.numbered(_edge_features(f))), A.smoothing(f.edges().select("edge_id"), A.lower_laplacian(f.boundary_1()), None, 0.5, 0.0)))
query(
    "ewma_state",
    _EDGE + _GRAM + " SELECT a.t, a.f, a.g, round(0.5 * sum(b.val * power(0.5, a.t - b.t)) / 1e6, 6) AS val FROM gm a JOIN gm b ON b.f = a.f AND b.g = a.g AND b.t <= a.t GROUP BY 1, 2, 3",
)(lambda f: X.ewma(X.gram(settle(X.numbered(_edge_features(f)))), ["f", "g"], GAMMA).withColumn("val", F.round(F.col("val") / 1e6, 6)))  # in millions: sums of doubles
query("soft_threshold", "SELECT cell_id, t, (sign(x) * greatest(abs(x) - 10.0, 0.0))::DOUBLE AS x FROM s1")(lambda f: f.edge_signal().select("cell_id", "t", X.soft_threshold(F.col("x").cast("double"), 10.0).alias("x")))

# ---- exchange: the whole timeline, C_data = 2 unless said
_MSG = """, sg AS (SELECT * FROM signal), msg AS MATERIALIZED (SELECT t, src, dst, kind, dim, cell_id, x AS value FROM (
  SELECT dst AS src, src AS dst, 'owned' AS kind, dim, cell_id FROM needs UNION ALL SELECT src, dst, 'interface', dim, cell_id FROM iface2) JOIN sg USING (dim, cell_id) WHERE t % 2 = 0),
want AS (SELECT src, dst, dim, cell_id, t FROM needs, (SELECT t FROM months))"""


def _exchange(f: Fixture):
    p, s = f.partition(), f.signal()
    both = G.neighbour_interface(p.interface)
    wanted = p.needs.crossJoin(counted(f.months().select("t")))
    return p, s, both, E.messages(p.needs, both, s, 2), wanted


query("kstep_data", "SELECT t FROM months WHERE t % 10 = 0")(lambda f: E.gate(f.months().select("t"), 10))
query("kstep_params", "SELECT t FROM months WHERE t % 3 = 0")(lambda f: E.gate(f.months().select("t"), 3))
query("kstep_rule", "SELECT t FROM months WHERE t % 4 = 1 OR t = 6")(lambda f: E.gate(f.months().select("t"), 10, (F.col("t") % 4 == 1) | (F.col("t") == 6)))
query("export_messages", _MSG + " SELECT * FROM msg")(lambda f: _exchange(f)[3])
query("outbox_latest", _MSG + " SELECT src, dst, kind, dim, cell_id, arg_max(value, t) AS value, max(t) AS t FROM msg GROUP BY 1, 2, 3, 4, 5")(lambda f: E.latest(_exchange(f)[3], ["src", "dst", "kind", "dim", "cell_id"], "value"))
query("inbox_fresh", _MSG + " SELECT m.* FROM msg m WHERE t % 3 <> 1")(lambda f: E.fresh(_exchange(f)[3], f.months().filter("t % 3 <> 1").select("t")).select("t", "src", "dst", "kind", "dim", "cell_id", "value"))
query("inbox_stale", _MSG + " SELECT n.t, src, dst, kind, dim, cell_id, arg_max(value, m.t) AS value FROM (SELECT t FROM months) n JOIN msg m ON m.t <= n.t GROUP BY 1, 2, 3, 4, 5, 6")(
    lambda f: E.fresh(_exchange(f)[3], f.months().select("t"), accept_stale=True).select("t", "src", "dst", "kind", "dim", "cell_id", "value")
)
query("impute_zero", _MSG + " SELECT w.*, coalesce(value, 0)::BIGINT AS value FROM want w LEFT JOIN (SELECT * FROM msg WHERE kind = 'owned') m ON m.src = w.dst AND m.dst = w.src AND m.dim = w.dim AND m.cell_id = w.cell_id AND m.t = w.t")(
    lambda f: (lambda x: E.impute_zero(x[4], x[3].filter("kind = 'owned'")).select("src", "dst", "dim", "cell_id", "t", "value"))(_exchange(f))
)
query("impute_hold", _MSG + " SELECT w.*, coalesce(s.x, 0)::BIGINT AS value FROM want w LEFT JOIN sg s ON s.dim = w.dim AND s.cell_id = w.cell_id AND s.t = w.t - w.t % 2")(
    lambda f: (lambda x: E.impute_hold(x[4], x[3].filter("kind = 'owned'")).withColumn("value", F.col("value").cast("long")))(_exchange(f))
)
query("receipts", "SELECT t, src, dst FROM (SELECT src, dst FROM mhw WHERE src <> dst UNION SELECT src, src FROM mhw) JOIN months ON (t + dst) % 4 = 0 OR t = 10")(
    lambda f: (lambda p: E.receipts(G.metropolis_weights(p.agent_graph, p.owned), f.months(), F.expr("(t + agent) % 4 = 0 or t = 10")))(f.partition())
)
_SEEN = """, ob AS (SELECT i.src, i.dst, i.dim, i.cell_id, s.t, s.x * (1 + 0.1::DOUBLE * (i.src % 3)) AS x FROM iface2 i JOIN signal s USING (dim, cell_id)),
ex AS (SELECT n.src AS cluster_id, n.dst AS sender, n.dim, n.cell_id, s.t, s.x::DOUBLE AS value FROM needs n JOIN signal s USING (dim, cell_id) WHERE s.t % (3 + n.dst % 3) = 0
  UNION ALL SELECT a.src, a.dst, a.dim, a.cell_id, a.t, 0.5 * (a.x + b.x) FROM ob a JOIN ob b ON b.src = a.dst AND b.dst = a.src AND b.dim = a.dim AND b.cell_id = a.cell_id AND b.t = a.t WHERE a.t % (3 + a.dst % 3) = 0),
ar AS MATERIALIZED (SELECT cluster_id, dim, cell_id, t, arg_max(value, sender) AS value FROM ex GROUP BY 1, 2, 3, 4)"""


def _arrived(f: Fixture) -> DataFrame:
    from cobordia.plans.runs import observed

    p, s = f.partition(), f.signal()
    both = P.both_ways(p.interface)
    heard = E.senders(p.needs, both)
    return E.exchanged(heard, s, F.expr("t % (3 + agent % 3) = 0"), E.interface_copies(both, observed(f, p.interface, s)))


query("interface_exchanged", _SEEN + " SELECT cluster_id, dim, cell_id, t, round(value, 6) AS value FROM ar")(lambda f: _round(_arrived(f), "value"))
query("interface_held", _SEEN + " SELECT k.cluster_id, k.dim, k.cell_id, m.t, round(arg_max(ar.value, ar.t), 6) AS value FROM (SELECT DISTINCT cluster_id, dim, cell_id FROM ar) k CROSS JOIN months m JOIN ar ON ar.cluster_id = k.cluster_id AND ar.dim = k.dim AND ar.cell_id = k.cell_id AND ar.t <= m.t GROUP BY 1, 2, 3, 4")(
    lambda f: _round(E.until_next(_arrived(f), ["cluster_id", "dim", "cell_id"], f.months().agg(F.max("t").alias("last"))), "value")
)
query("projected_global", "SELECT o.cluster_id, dim, cell_id, t, x FROM owned o JOIN signal USING (dim, cell_id)")(lambda f: G.project(f.signal(), f.partition().owned))
_COPY = ", cp AS (SELECT DISTINCT src AS cluster_id, dim, cell_id, t, (x + src) AS x FROM iface2 JOIN sg USING (dim, cell_id)), mc AS (SELECT dst AS cluster_id, dim, cell_id, t, arg_max(value, src) AS value FROM msg WHERE kind = 'interface' GROUP BY 1, 2, 3, 4)"


def _copies(f: Fixture):
    p, s, both, sent, _ = _exchange(f)
    copies = G.local_signal(s, both.select(F.col("src").alias("cluster_id"), "dim", "cell_id").distinct())
    return p, s, both, sent, copies.withColumn("x", F.col("x") + F.col("cluster_id"))


query("interface_average", _MSG + _COPY + " SELECT cluster_id, dim, cell_id, t, CASE WHEN value IS NULL THEN x * 1.0 ELSE 0.5 * (value + x) END::DOUBLE AS x FROM cp LEFT JOIN mc USING (cluster_id, dim, cell_id, t)")(
    lambda f: (lambda x: E.average_interface(x[4], x[3]).withColumn("x", F.col("x").cast("double")))(_copies(f))
)
query("append_owned", _MSG + " SELECT l.cluster_id, l.dim, l.cell_id, s.t, coalesce(m.value, s.x * 0)::BIGINT AS x FROM lidx l JOIN sg s USING (dim, cell_id) LEFT JOIN (SELECT DISTINCT dst, dim, cell_id, t, value FROM msg WHERE kind = 'owned') m ON m.dst = l.cluster_id AND m.dim = l.dim AND m.cell_id = l.cell_id AND m.t = s.t")(
    lambda f: (lambda x: E.take_owned(G.local_signal(x[1], x[0].local_index).withColumn("x", F.col("x") * 0), x[3]).withColumn("x", F.col("x").cast("long")))(_exchange(f))
)
query("masked_view", _MSG + ", h AS (SELECT src AS cluster_id, dim, cell_id FROM needs UNION SELECT src, dim, cell_id FROM iface2) SELECT l.cluster_id, l.dim, l.cell_id, s.t, CASE WHEN h.cell_id IS NOT NULL THEN 0 ELSE s.x END::BIGINT AS x FROM lidx l JOIN sg s USING (dim, cell_id) LEFT JOIN h ON h.cluster_id = l.cluster_id AND h.dim = l.dim AND h.cell_id = l.cell_id")(
    lambda f: (lambda x: E.split_local(G.local_signal(x[1], x[0].local_index), x[0].needs, x[2])[0].withColumn("x", F.col("x").cast("long")))(_exchange(f))
)


@query("label_propagation")
def label_propagation(f: Fixture) -> DataFrame:
    """What others own, smoothed from each cluster's own cells, in all three dimensions."""
    x = _exchange(f)
    local, stale = settle(G.local_signal(x[1], x[0].local_index)), settle(x[0].needs.select(F.col("src").alias("cluster_id"), "dim", "cell_id").distinct())
    parts = [E.propagate_labels(local.filter(F.col("dim") == dim), A.hodge(f.boundaries(), dim), stale.filter(F.col("dim") == dim)) for dim in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- mixing: parameters derived from the signal, a vector per cluster: even months now, odd months before (one shorter)
_PAR = ", par AS (SELECT cluster_id AS agent, t // 2 AS idx, (sum(x) % 101)::DOUBLE AS value FROM community JOIN s1 USING (cell_id) WHERE t % 2 = 0 GROUP BY 1, 2), od AS (SELECT cluster_id AS agent, t // 2 AS idx, (sum(x) % 101)::DOUBLE AS value FROM community JOIN s1 USING (cell_id) WHERE t % 2 = 1 GROUP BY 1, 2), old AS (SELECT agent, idx, coalesce(od.value, 0) AS value FROM par LEFT JOIN od USING (agent, idx)), z AS (SELECT agent, idx, old.value - par.value AS value FROM par JOIN old USING (agent, idx))"


def _params(f: Fixture):
    s = f.edge_signal().join(f.community(), "cell_id").groupBy(F.col("cluster_id").alias("agent"), "t").agg((F.sum("x") % 101).cast("double").alias("value"))
    half = F.floor(F.col("t") / 2).alias("idx")
    return G.metropolis_weights(f.partition().agent_graph, f.community()), s.filter("t % 2 = 0").select("agent", half, "value"), s.filter("t % 2 = 1").select("agent", half, "value")


query("atc_mix", _PAR + " SELECT src AS agent, idx, round(sum(w * value), 6) AS value FROM mhw JOIN par ON agent = dst GROUP BY 1, 2")(lambda f: (lambda x: _round(C.mix_atc(x[0], x[1]), "value"))(_params(f)))
query("kgt_aux", _PAR + " SELECT * FROM z")(lambda f: (lambda x: C.kgt_aux(x[1], x[2]))(_params(f)))
query("kgt_correction", _PAR + " SELECT p.agent, p.idx, round(any_value(p.value) - any_value(own.value) + sum(w * z.value), 6) AS value FROM par p JOIN z own ON own.agent = p.agent AND own.idx = p.idx JOIN mhw ON src = p.agent JOIN z ON z.agent = dst AND z.idx = p.idx GROUP BY 1, 2")(
    lambda f: (lambda x: _round(C.kgt_correction(x[1], C.kgt_aux(x[1], x[2]), x[0]), "value"))(_params(f))
)
query("kgt_mix", _PAR + " SELECT src AS agent, p.idx, round(sum(w * (CASE WHEN src = dst THEN o.value ELSE p.value END - z.value)), 6) AS value FROM mhw JOIN par p ON p.agent = dst JOIN old o ON o.agent = dst AND o.idx = p.idx JOIN z ON z.agent = dst AND z.idx = p.idx GROUP BY 1, 2")(
    lambda f: (lambda x: _round(C.kgt_mix(x[0], x[1], x[2], C.kgt_aux(x[1], x[2])), "value"))(_params(f))
)
query("kgt_gradient", _PAR + " SELECT par.agent, par.idx, 0.5 * (par.value + z.value) AS value FROM par JOIN z USING (agent, idx)")(
    lambda f: (lambda x: x[1].join(C.kgt_aux(x[1], x[2]).withColumnRenamed("value", "z"), ["agent", "idx"]).select("agent", "idx", C.kgt_gradient(F.col("value"), F.col("z"), 0.5).alias("value")))(_params(f))
)

# ---- metrics on persistence forecasts of each cluster, h = 1 (case 1) and 3 (case 3)
_FC = """, fc AS MATERIALIZED (SELECT c.case_id, o.cluster_id, o.dim, o.cell_id, s.t AS i, s.x::DOUBLE AS yhat FROM owned0 o JOIN signal s USING (dim, cell_id), (VALUES (1::BIGINT), (3)) c(case_id) WHERE s.t + c.case_id <= (SELECT max(t) FROM months)),
truth AS MATERIALIZED (SELECT s.dim, s.cell_id, s.t - c.case_id AS i, s.x AS y, c.case_id FROM signal s, (VALUES (1::BIGINT), (3)) c(case_id) WHERE s.t >= c.case_id),
ag AS MATERIALIZED (SELECT case_id, dim, i, cell_id, avg(yhat) AS yhat FROM fc GROUP BY 1, 2, 3, 4),
jt AS MATERIALIZED (SELECT ag.*, y FROM ag JOIN truth USING (case_id, dim, cell_id, i)),
tv AS MATERIALIZED (SELECT case_id, dim, i, CASE WHEN sum(y * y) > 0 THEN sum((yhat - y) * (yhat - y)) / sum(y * y) END AS tv_nmse, avg(abs(yhat - y)) AS tv_mae, avg(CASE WHEN y <> 0 THEN abs((yhat - y) / y) END) * 100 AS tv_mape FROM jt GROUP BY 1, 2, 3)"""


def _forecasts(f: Fixture):
    p, s = f.partition(), f.signal()
    parts, truths = [], []
    last = f.months().agg(F.max("t")).first()[0]
    for h in (1, 3):
        made = M.persistence(s, h).filter(F.col("t_eval") <= F.lit(last))
        parts.append(p.owned0.join(made, ["dim", "cell_id"]).select(F.lit(h).cast("long").alias("case_id"), "cluster_id", "dim", "cell_id", F.col("t_made").alias("i"), "yhat"))
        truths.append(s.filter(F.col("t") >= h).select(F.lit(h).cast("long").alias("case_id"), "dim", "cell_id", (F.col("t") - h).alias("i"), F.col("x").alias("y")))
    return p, parts[0].unionByName(parts[1]), truths[0].unionByName(truths[1])


def _joined(f: Fixture) -> DataFrame:
    _, made, truth = _forecasts(f)
    return M.aggregate(made).join(truth, [*M.STEP, "cell_id"])


query("forecast_persistence", "SELECT dim, cell_id, t + 2 AS t_eval, t AS t_made, x::DOUBLE AS yhat FROM signal")(lambda f: M.persistence(f.signal(), 2))
query("aggregate_partial", _FC + " SELECT * FROM ag")(lambda f: M.aggregate(_forecasts(f)[1]))
query("masked_truth", _FC + " SELECT * FROM jt")(_joined)
for _name in ("tv_nmse", "tv_mae", "tv_mape"):
    query(_name, _FC + f" SELECT case_id, dim, i, round({_name}, 6) AS {_name} FROM tv")(lambda f, n=_name: _round(M.tv_metrics(_joined(f)).select(*M.STEP, n), n))
query(
    "rolling_nmse",
    _FC + ", st AS (SELECT DISTINCT case_id, dim, i FROM jt), gr AS (SELECT st.case_id, st.dim, c.cell_id, st.i, coalesce((yhat - y) * (yhat - y), 0) AS e, coalesce(y * y, 0) AS g FROM st JOIN cells c ON c.dim = st.dim LEFT JOIN jt ON jt.case_id = st.case_id AND jt.dim = st.dim AND jt.i = st.i AND jt.cell_id = c.cell_id), cu AS (SELECT case_id, dim, i, sum(e) OVER w AS ce, sum(g) OVER w AS cg FROM gr WINDOW w AS (PARTITION BY case_id, dim, cell_id ORDER BY i)) SELECT case_id, dim, i, round(avg(CASE WHEN cg <> 0 THEN ce / cg END), 6) AS rolling_nmse FROM cu GROUP BY 1, 2, 3",
)(lambda f: (lambda j: _round(M.rolling_nmse(j, f.cells(), j.select(*M.STEP).distinct()), "rolling_nmse"))(_joined(f)))
for _name in ("mae", "mape"):
    query(f"rolling_{_name}", _FC + f" SELECT case_id, dim, i, round(CASE WHEN count(tv_{_name}) OVER w = count(*) OVER w THEN avg(tv_{_name}) OVER w END, 6) AS rolling_{_name} FROM tv WINDOW w AS (PARTITION BY case_id, dim ORDER BY i)")(
        lambda f, n=_name: _round(M.rolling(M.tv_metrics(_joined(f)), f"tv_{n}", f"rolling_{n}"), f"rolling_{n}")
    )
query("interface_nmse", _FC + ", ic AS (SELECT DISTINCT dim, cell_id FROM iface), ie AS (SELECT t.case_id, t.dim, t.i, sum((coalesce(yhat, 0) - y) * (coalesce(yhat, 0) - y)) AS e, sum(y * y) AS g FROM truth t JOIN ic USING (dim, cell_id) LEFT JOIN ag ON ag.case_id = t.case_id AND ag.dim = t.dim AND ag.cell_id = t.cell_id AND ag.i = t.i GROUP BY 1, 2, 3 HAVING sum(y * y) > 0) SELECT case_id, dim, i, round(e / g, 6) AS interface_nmse FROM ie UNION ALL SELECT case_id, -1, i, round(sum(e) / sum(g), 6) FROM ie GROUP BY 1, 3")(
    lambda f: (lambda x: _round(M.interface_nmse(M.aggregate(x[1]).filter("case_id = 1"), x[2].filter("case_id = 1").drop("case_id"), x[0].interface).unionByName(M.interface_nmse(M.aggregate(x[1]).filter("case_id = 3"), x[2].filter("case_id = 3").drop("case_id"), x[0].interface)), "interface_nmse").na.fill({"dim": -1}))(_forecasts(f))
)
query("interface_cells", "SELECT DISTINCT dim, cell_id FROM iface")(lambda f: M.interface_cells(f.partition().interface))
_TAIL = " SELECT case_id, dim, round(avg(v), 6) AS tail_mean FROM (SELECT case_id, dim, v, row_number() OVER (PARTITION BY case_id, dim ORDER BY i DESC) AS r, count(*) OVER (PARTITION BY case_id, dim) AS n FROM {x}) WHERE r <= ceil(n * 0.1) GROUP BY 1, 2"


def _gappy(f: Fixture) -> DataFrame:
    return M.tv_metrics(_joined(f)).select(*M.STEP, F.when(F.col("i") % 3 != 0, F.col("tv_mae")).alias("v"))


_GAPPY = _FC + ", gp AS (SELECT case_id, dim, i, CASE WHEN i % 3 <> 0 THEN tv_mae END AS v FROM tv), gf AS (SELECT * FROM gp WHERE v IS NOT NULL)"
query("tail_mean", _GAPPY + _TAIL.format(x="gp"))(lambda f: _round(M.tail_mean(_gappy(f), "v"), "tail_mean"))
query("tail_mean_finite_first", _GAPPY + _TAIL.format(x="gf"))(lambda f: _round(M.tail_mean(_gappy(f), "v", finite_first=True), "tail_mean"))
query("last_finite", _GAPPY + " SELECT case_id, dim, round(arg_max(v, i), 6) AS last FROM gf GROUP BY 1, 2")(lambda f: _round(M.last_value(_gappy(f), "v"), "last"))
query("comparison_table", _FC + " SELECT metric, round(max(CASE WHEN case_id = 1 THEN v END), 6) AS h1, round(max(CASE WHEN case_id = 3 THEN v END), 6) AS h3 FROM (SELECT case_id, 'tvMAE' AS metric, avg(tv_mae) AS v FROM tv WHERE dim = 1 GROUP BY 1 UNION ALL SELECT case_id, 'tvMAPE', avg(tv_mape) FROM tv WHERE dim = 1 GROUP BY 1) GROUP BY metric")(
    lambda f: _round(
        M.comparison_table(
            M.tv_metrics(_joined(f)).filter("dim = 1").groupBy("case_id").agg(F.avg("tv_mae").alias("tvMAE"), F.avg("tv_mape").alias("tvMAPE")).select(F.concat(F.lit("h"), "case_id").alias("case_id"), F.expr("stack(2, 'tvMAE', tvMAE, 'tvMAPE', tvMAPE) as (metric, value)")), ["h1", "h3"]
        ), "h1", "h3",
    )
)
query("horizon_select", ", w AS (SELECT dim AS case_id, h AS horizon, dim, cell_id, t + h AS t_eval, t AS t_made, x::DOUBLE AS yhat FROM signal, (VALUES (1::BIGINT), (2), (3)) v(h) WHERE h <= dim + 1) SELECT w.* FROM w JOIN (SELECT case_id, least(2, max(horizon)) AS h FROM w GROUP BY 1) m ON m.case_id = w.case_id AND m.h = horizon")(
    lambda f: M.at_horizon(reduce(DataFrame.unionByName, (M.persistence(f.signal().filter(F.col("dim") >= h - 1), h).withColumn("case_id", F.col("dim")).withColumn("horizon", F.lit(h).cast("long")) for h in (1, 2, 3))), 2)
)

# ---- disagreement: a parameter per month of the year, agents = clusters, t = year
_DIS = """, dp AS (SELECT 1::BIGINT AS case_id, cluster_id AS agent, t // 12 AS t, t % 12 AS idx, sum(x)::DOUBLE AS value FROM community JOIN s1 USING (cell_id) GROUP BY 1, 2, 3, 4), rf AS (SELECT t, idx, avg(value) + 3 AS ref FROM dp GROUP BY 1, 2),
ctr AS (SELECT dp.*, ref, avg(value) OVER (PARTITION BY dp.t, dp.idx) AS mean FROM dp JOIN rf ON rf.t = dp.t AND rf.idx = dp.idx),
pa AS (SELECT case_id, t, agent, sum((value - mean) * (value - mean)) AS d2, sum((value - ref) * (value - ref)) AS g2, count(*) AS n, sum((mean - ref) * (mean - ref)) AS c2, sum(ref * ref) AS r2 FROM ctr GROUP BY 1, 2, 3),
dm AS (SELECT case_id, t, sum(d2) / sum(n) AS self_disagreement, sqrt(avg(d2)) AS self_rms, avg(sqrt(g2)) AS global_disagreement, sqrt(max(c2)) AS centroid_to_global, sqrt(max(c2)) / greatest(sqrt(max(r2)), 1e-12) AS centroid_to_global_relative, sqrt(avg(g2)) AS global_rms, sqrt(avg(g2)) / greatest(sqrt(max(r2)), 1e-12) AS global_rms_relative FROM pa GROUP BY 1, 2)"""


def _disagreement(f: Fixture) -> DataFrame:
    s = f.edge_signal().join(f.community(), "cell_id")
    p = s.groupBy(F.lit(1).cast("long").alias("case_id"), F.col("cluster_id").alias("agent"), F.floor(F.col("t") / 12).alias("t"), (F.col("t") % 12).alias("idx")).agg(F.sum("x").cast("double").alias("value"))
    return M.disagreement(p, p.groupBy("t", "idx").agg((F.avg("value") + 3).alias("ref")))


for _name, _columns in {
    "self_disagreement": ["self_disagreement"],
    "self_rms": ["self_rms"],
    "global_disagreement": ["global_disagreement"],
    "centroid_to_global": ["centroid_to_global", "centroid_to_global_relative"],
    "global_rms": ["global_rms", "global_rms_relative"],
}.items():
    query(_name, _DIS + " SELECT case_id, t, " + ", ".join(f"round({c}, 6) AS {c}" for c in _columns) + " FROM dm")(lambda f, c=_columns: _round(_disagreement(f).select("case_id", "t", *c), *c))
for _name, _column in {
    "rolling_disagreement": "self_disagreement", "rolling_self_rms": "self_rms", "rolling_global_disagreement": "global_disagreement", "rolling_centroid_to_global": "centroid_to_global",
    "rolling_centroid_to_global_relative": "centroid_to_global_relative", "rolling_global_rms": "global_rms", "rolling_global_rms_relative": "global_rms_relative",
}.items():
    query(_name, _DIS + f" SELECT case_id, t, round(avg({_column}) OVER (ORDER BY t), 6) AS rolling_{_column} FROM dm")(
        lambda f, c=_column: _round(M.rolling(_disagreement(f), c, f"rolling_{c}", ("case_id",), "t"), f"rolling_{c}")
    )
