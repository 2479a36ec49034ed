"""A complex small enough to check by hand: four nodes, five edges, two triangles."""

import numpy as np
import pandas as pd
import pytest

from cobordia.operators import agents as G
from cobordia.operators import exchange as E
from cobordia.operators import features as X
from cobordia.operators import incidence as A
from cobordia.operators import learning as L
from cobordia.operators import metrics as M
from cobordia.operators import neighbourhood as N
from cobordia.operators import partition as P
from cobordia.functions import registry
from cobordia.sources import readers, sinks

B1 = np.array([[-1, -1, 0, 0, 0], [1, 0, -1, -1, 0], [0, 1, 1, 0, -1], [0, 0, 0, 1, 1]])
B2 = np.array([[1, 0], [-1, 0], [1, -1], [0, 1], [0, -1]])
B2[2:, 1] = [1, -1, 1]
SIGNAL = np.array([[((t + 1) * (j + 1)) % 7 - 3 for t in range(4)] for j in range(5)])


@pytest.fixture(scope="module")
def b(spark):
    return {k: readers.from_boundary(spark, m, k).select("i", "j", "val").cache() for k, m in ((1, B1), (2, B2))}


@pytest.fixture(scope="module")
def edge_signal(spark):
    return readers.from_matrix(spark, SIGNAL, 1).select("cell_id", "t", "x").cache()


def dense(m, n, k=None):
    out = np.zeros((n, k or n))
    for r in m.collect():
        out[r["i"], r["j"]] = r["val"]
    return out


def test_laplacians(b):
    lower, upper = A.laplacians(b, 1)
    assert (dense(lower, 5) == B1.T @ B1).all() and (dense(upper, 5) == B2 @ B2.T).all()
    assert (dense(A.hodge(b, 1), 5) == B1.T @ B1 + B2 @ B2.T).all()
    assert N.boundary_of_boundary(b[1], b[2]).first()[0] == 0 == np.abs(B1 @ B2).sum()


def test_cancelled_neighbours(b):
    assert {(r["i"], r["j"]) for r in N.edge_adjacency(b).collect()} == {(0, 3), (3, 0), (1, 4), (4, 1)}
    assert N.self_adjacency(A.hodge(b, 1), 2, zero_diagonal=True).count() == 0
    assert N.self_adjacency(A.hodge(b, 1), 2).count() == 4


def test_powers_and_submatrix(b, spark):
    lower = A.lower_laplacian(b[1])
    assert (dense(A.power(lower, 3), 5) == np.linalg.matrix_power(B1.T @ B1, 3)).all()
    some = spark.createDataFrame([(0,), (3,)], "id long")
    assert A.submatrix(lower, some, some).count() == 4


def test_weights(b):
    g = P.only_edges(b)
    w = {(r["src"], r["dst"]): r["w"] for r in G.metropolis_weights(g["agent_graph"], g["owned"]).collect()}
    assert w[0, 3] == w[3, 0] == w[0, 0] == 0.5 and w[2, 2] == 1.0 and len(w) == 9


def test_topolms_trace(b, spark, edge_signal):
    x = X.topolms(A.lower_laplacian(b[1]), A.upper_laplacian(b[2]), edge_signal, 2)
    lu, ll = B2 @ B2.T, B1.T @ B1
    want = np.column_stack([lu @ lu @ SIGNAL[:, 1], lu @ SIGNAL[:, 2], SIGNAL[:, 3], ll @ ll @ SIGNAL[:, 2], ll @ SIGNAL[:, 3]])
    got = np.zeros((5, 5))
    for r in x.filter("t = 3").collect():
        got[r["i"], r["f"]] = r["s"]
    assert (got == want).all()
    f = x.selectExpr("0L as case_id", "1L as dim", "0L as agent", "i", "t + 1 as t", "f", "cast(s as double) as s")
    keys = ["case_id", "dim", "agent", "t"]
    y = f.join(edge_signal.selectExpr("cell_id as i", "t", "x as y"), ["i", "t"]).selectExpr(*keys, "f", "s * y as v").groupBy(*keys, "f").agg({"v": "sum"}).withColumnRenamed("sum(v)", "val")
    weights = spark.createDataFrame([(0, 0, 0, 1.0)], "case_id long, src long, dst long, w double")
    theta = L.sequential(A.gram(f, keys), y, weights, {0: L.Rule(gamma=0.0)}, 5).collect()
    last = [r["value"] for r in sorted(theta, key=lambda r: (r["t"], r["idx"]))][-5:]
    assert np.allclose(last, [0.001325, 0.022744, -0.014847, -0.028301, -0.064949], atol=2e-6)
    ahead = L.topolms_forecast(want.astype(float), np.array(last), ll, lu, 2, 1)
    assert np.allclose(ahead, [-0.171782, -0.337664, -0.573772, -0.050830, 0.075917], atol=2e-5)
    assert L.topolms_forecast(want.astype(float), np.array(last), ll, lu, 2, 3).shape == (5,)


def test_fold_against_a_loop():
    draw = np.random.default_rng(0)
    s = draw.normal(size=(6, 3, 4, 5))
    grams, rhs = np.einsum("taif,taig->tafg", s, s), draw.normal(size=(6, 3, 5))
    w = np.full((3, 3), 1 / 3)
    got = L.run_fold(grams, rhs, w, L.Rule(gamma=0.9, mixing="atc", clock=2))
    theta, phi, r = np.zeros((3, 5)), np.zeros((3, 5, 5)), np.zeros((3, 5))
    for t in range(6):
        for a in range(3):
            phi[a] = 0.9 * phi[a] + 0.1 * grams[t, a]
            r[a] = 0.9 * r[a] + 0.1 * rhs[t, a]
            theta[a] = theta[a] - (phi[a] @ theta[a] - r[a]) / (1e-4 + np.linalg.eigvalsh(phi[a])[-1])
        if t % 2 == 0:
            theta = np.stack([sum(w[a, c] * theta[c] for c in range(3)) for a in range(3)])
        assert np.allclose(got[t], theta)
    assert np.allclose(L.run_fold(grams, rhs, w, L.Rule(gamma=0.9, mixing="atc", consensus="never")), L.run_fold(grams, rhs, w, L.Rule(gamma=0.9)))
    alone = L.run_fold(grams, rhs, np.eye(3), L.Rule(gamma=0.9, mixing="atc", clock=1))
    assert np.allclose(alone, L.run_fold(grams, rhs, np.eye(3), L.Rule(gamma=0.9)))


def test_folds_of_every_mixing(spark):
    """K-GT, gating, isolated agents and the threshold by a loop over agents; and the same from tables, agent by agent."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(7, 4, 6, 3))
    grams, rhs = np.einsum("taif,taig->tafg", x, x), draw.normal(size=(7, 4, 3))
    w = np.array([[0.5, 0.5, 0, 0], [0.5, 0.2, 0.3, 0], [0, 0.3, 0.7, 0], [0, 0, 0, 1.0]])
    rows = [(t, a, f, g, float(grams[t, a, f, g])) for t, a, f, g in np.ndindex(7, 4, 3, 3)]
    g = spark.createDataFrame(rows, "t long, agent long, f long, g long, val double").selectExpr("9L as case_id", "2L as dim", "*")
    r = spark.createDataFrame([(t, a, f, float(rhs[t, a, f])) for t, a, f in np.ndindex(7, 4, 3)], "t long, agent long, f long, val double").selectExpr("9L as case_id", "2L as dim", "*")
    mix = spark.createDataFrame([(9, i, j, float(w[i, j])) for i, j in np.ndindex(4, 4) if w[i, j]], "case_id long, src long, dst long, w double")
    for rule in (L.Rule(0.9, "kgt", 3, 1.5, 0.7, 0.9), L.Rule(0.8, "kgt", 2, consensus="always"), L.Rule(0.9, "atc", 2, consensus="always"), L.Rule(0.9, "atc", 3, threshold=0.01), L.Rule(0.9, "none")):
        theta, phi, rr, z, c, old = (np.zeros(k) for k in ((4, 3), (4, 3, 3), (4, 3), (4, 3), (4, 3), (4, 3)))
        want = []
        for t in range(7):
            ticks = t % rule.clock == 0
            for a in range(4):
                phi[a], rr[a] = rule.gamma * phi[a] + (1 - rule.gamma) * grams[t, a], rule.gamma * rr[a] + (1 - rule.gamma) * rhs[t, a]
                gradient = phi[a] @ theta[a] - rr[a]
                if rule.mixing == "kgt":
                    gradient = rule.c * (gradient + c[a])
                theta[a] = theta[a] - gradient / (1e-4 + np.linalg.eigvalsh(phi[a])[-1])
                if rule.threshold:
                    theta[a] = np.sign(theta[a]) * np.maximum(np.abs(theta[a]) - rule.threshold, 0)
            if rule.mixing == "kgt" and ticks:
                z = (old - theta) / (rule.k * rule.c)
            sent, new = theta.copy(), theta.copy()
            for a in range(4):
                came = [b for b in range(4) if b != a and w[a, b] and ticks]
                if rule.mixing == "none" or (rule.consensus == "gated" and not came):
                    continue
                if rule.mixing == "atc":
                    new[a] = w[a, a] * sent[a] + sum(w[a, b] * sent[b] for b in came)
                else:
                    kcs = rule.k * rule.c * rule.s
                    c[a] = c[a] - z[a] + w[a, a] * z[a] + sum(w[a, b] * z[b] for b in came)
                    new[a] = w[a, a] * (old[a] - kcs * z[a]) + sum(w[a, b] * (sent[b] - kcs * z[b]) for b in came)
            if rule.mixing == "kgt":
                old = np.where((new != sent).any(axis=1)[:, None] | (rule.consensus == "always"), new, old)
            theta = new
            want.append(theta.copy())
        assert np.allclose(L.run_fold(grams, rhs, w, rule), want), rule
        for together in (L.TOGETHER, 0):
            got = np.full((7, 4, 3), np.nan)
            for row in L.sequential(g, r, mix, {9: rule}, {2: 3}, together).collect():
                assert (row["case_id"], row["dim"]) == (9, 2)
                got[row["t"], row["agent"], row["idx"]] = row["value"]
            assert np.allclose(got, want), (rule, together)


NODES = np.array([[((t + 2) * (j + 1)) % 5 - 2 for t in range(7)] for j in range(4)])
EDGES = np.array([[((t + 1) * (j + 1)) % 7 - 3 for t in range(7)] for j in range(5)])
FACES = np.array([[((t + 3) * (j + 2)) % 6 - 2 for t in range(7)] for j in range(2)])


def ccvar_loop(plan, view, own, out, weights, horizon, arrived=None, sends=None):
    """θ after each step and forecasts, by agents that keep dense local matrices and lag buffers. ``arrived(a, d, t)``: values
    of others' cells in place of the clock's; ``sends(t, a)``: who sends parameters, in place of the clock."""
    model, rule, full = plan.model, plan.rule, {0: NODES, 1: EDGES, 2: FACES}
    agents, theta, ahead = sorted(view), {}, {}
    local = {}
    for a in agents:
        b = {1: B1[np.ix_(view[a][0], view[a][1])], 2: B2[np.ix_(view[a][1], view[a][2])]}
        local[a] = {d: (b[d].T @ b[d] if d else None, b[d + 1] @ b[d + 1].T if d < 2 else None, b.get(d), b.get(d + 1)) for d in range(3)}

    def features(a, buffer, d, scale):
        low, up, down, above = local[a][d]
        k_low, k_up = model.pair(model.powers, d)
        parts = []
        power = lambda m, k: np.linalg.matrix_power(m, k)
        if low is not None and d - 1 in model.dims:
            parts += [power(low, k) @ down.T @ buffer[d - 1][p] for k in range(1, k_low + 1) for p in range(model.lag)]
        if low is not None:
            parts += [power(low, k) @ buffer[d][p] for k in range(1, k_low + 1) for p in range(model.lag)]
        if up is not None:
            parts += [power(up, k) @ buffer[d][p] for k in range(1, k_up + 1) for p in range(model.lag)]
        if up is not None and d + 1 in model.dims:
            parts += [power(up, k) @ above @ buffer[d + 1][p] for k in range(1, k_up + 1) for p in range(model.lag)]
        s = np.column_stack([*parts, np.ones(len(view[a][d]))])
        if model.normalise:
            square = (s**2).sum(axis=0)
            s = s / np.sqrt(np.where(square == 0, 0.001, square)) * scale
        return s

    buffers = {a: {d: [np.zeros(len(view[a][d])) for _ in range(model.lag)] for d in range(3)} for a in agents}
    state, scales = {}, {(a, d): 0.0 for a in agents for d in range(3)}
    for t in range(7):
        for a in agents:
            for d in model.dims:
                scales[a, d] = (1 - model.b) * scales[a, d] + model.b * np.sqrt((buffers[a][d][0] ** 2).sum())
                s = features(a, buffers[a], d, scales[a, d])
                rows = [view[a][d].index(c) for c in out[a][d]]
                low, up = local[a][d][:2]
                r = np.eye(len(rows))
                for m, mu in zip((low, up), model.pair(model.mu, d), strict=True):
                    r = r + (mu * m[np.ix_(rows, rows)] if m is not None else 0)
                phi, rr, th, *_ = state.get((a, d), (0.0, 0.0, np.zeros(s.shape[1])))
                phi = rule.gamma * phi + (1 - rule.gamma) * s[rows].T @ r @ s[rows]
                rr = rule.gamma * rr + (1 - rule.gamma) * s[rows].T @ full[d][out[a][d], t]
                state[a, d] = phi, rr, th - (phi @ th - rr) / (1e-4 + np.linalg.eigvalsh(phi)[-1])
            for d in range(3):
                sent = t - t % plan.data_clock
                now = [full[d][c, t] if c in own[a][d] else (full[d][c, sent] if plan.imputer == "hold" else full[d][c, t] * (t == sent)) for c in view[a][d]]
                if arrived is not None:
                    now = [full[d][c, t] if c in own[a][d] else arrived(a, d, t).get(c, 0.0) for c in view[a][d]]
                buffers[a][d] = [np.array(now, float), *buffers[a][d][:-1]]
        if rule.mixing == "atc":
            before = {k: v[2] for k, v in state.items()}
            for a, d in state:
                came = [c for c in weights[a] if c != a and (sends(t, c) if sends else t % rule.clock == 0)]
                if came:
                    state[a, d] = (*state[a, d][:2], sum(weights[a][c] * before[c, d] for c in [a, *came]))
        for a, d in state:
            theta[t, a, d] = state[a, d][2]
        for a in agents:
            held = {d: list(v) for d, v in buffers[a].items()}
            for h in range(1, horizon + 1):
                made = {d: features(a, held, d, 1.0) @ state[a, d][2] for d in model.dims}
                for d in model.dims:
                    ahead[t, h, a, d] = made[d]
                    held[d] = [made[d], *held[d][:-1]]
    return theta, ahead


@pytest.mark.parametrize("changes", [{}, {"data_clock": 1, "model": {"mu": (0.1, (0.3, 0.2), 0.4), "powers": (1, (2, 1), 2)}}, {"imputer": "zero", "model": {"normalise": True, "b": 0.5}}, {"rule": {"mixing": "none"}, "model": {"dims": (1, 2)}}])
def test_three_dimensions_against_a_loop(spark, b, changes):
    from cobordia.plans import presets, runs

    plan = presets.merged(presets.PRESETS["default"], **{"data_clock": 3, "rule": {"clock": 2, "gamma": 0.9} | changes.get("rule", {}), **{k: v for k, v in changes.items() if k != "rule"}})
    parts = [readers.from_matrix(spark, m, d).select("dim", "cell_id", "t", "x") for d, m in enumerate((NODES, EDGES, FACES))]
    signal = runs.settle(runs.union(parts))
    community = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)], "cluster_id long, cell_id long")
    p = P.partition(b, community, 1, 1)
    weights = runs.settle(G.metropolis_weights(p.agent_graph, p.owned))
    out = runs.settle(G.partial_indices(p.local_index, p.owned).filter("is_out").select("cluster_id", "dim", "cell_id"))
    case = runs._case(plan, b, signal, p.local_index, p.owned, out, weights)
    sets = lambda d: {a: {k: sorted(r["cell_id"] for r in rows if (r["cluster_id"], r["dim"]) == (a, k)) for k in range(3)} for a in (0, 1)} if (rows := d.collect()) else None
    mixing = {a: {r["dst"]: r["w"] for r in weights.collect() if r["src"] == a} for a in (0, 1)}
    assert all(len(m) == 2 for m in mixing.values())
    theta, ahead = ccvar_loop(plan, sets(p.local_index), sets(p.owned), sets(out), mixing, 2)
    made = runs.learn({5: case}, signal)
    got = {}
    for r in made.collect():
        got.setdefault((r["t"], r["agent"], r["dim"]), {})[r["idx"]] = r["value"]
    assert set(got) == set(theta)
    for k, v in theta.items():
        assert np.allclose([got[k].get(n, np.nan) for n in range(len(v))], v, atol=1e-9), k
    if plan.model.normalise:
        return  # a rollout has no running scale
    view = sets(p.local_index)
    seen = {(r["t_made"], r["horizon"], r["i"] // runs.BLOCK, r["dim"], r["i"] % runs.BLOCK): r["yhat"] for r in runs.rolled(case, made, 2).collect()}
    assert len(seen) == sum(len(v) for v in ahead.values())
    for (t, h, a, d), v in ahead.items():
        assert np.allclose([seen[t, h, a, d, c] for c in view[a][d]], v, atol=1e-9), (t, h, a, d)
    one = {(r["i"], r["cluster_id"], r["dim"], r["cell_id"]): r["yhat"] for r in runs.forecasts({5: case}, made, everything=True).collect()}
    assert all(abs(one[t + 1, a, d, c] - seen[t, 1, a, d, c]) < 1e-9 for t, h, a, d, c in seen if h == 1 and t < 6)


THREE = [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)]


@pytest.mark.parametrize("imputer", ["hold", "zero"])
@pytest.mark.parametrize("interface", ["same", "averaged"])
def test_exchange_between_three_agents_against_a_loop(spark, b, imputer, interface):
    """Own copies of shared cells, clocks of each agent's own for data and parameters, and a fold in two parts."""
    from cobordia.plans import presets, runs

    plan = presets.merged(presets.PRESETS["default"], interface=interface, imputer=imputer, data_sends="(t + agent) % 3 = 1", rule={"sends": "t % (2 + agent) = 0", "gamma": 0.9})
    full = {0: NODES, 1: EDGES, 2: FACES}
    signal = runs.settle(runs.union(readers.from_matrix(spark, m, d).select("dim", "cell_id", "t", "x") for d, m in full.items()))
    p = P.partition(b, spark.createDataFrame(THREE, "cluster_id long, cell_id long"), 1, 1)
    weights = runs.settle(G.metropolis_weights(p.agent_graph, p.owned))
    out = runs.settle(G.partial_indices(p.local_index, p.owned).filter("is_out").select("cluster_id", "dim", "cell_id"))
    both = P.both_ways(p.interface)
    seen = both.select(runs.F.col("src").alias("cluster_id"), "dim", "cell_id").distinct().join(signal, ["dim", "cell_id"]).withColumn("x", runs.F.expr("x * (1 + cluster_id) + t"))
    copies = E.interface_copies(both, seen) if interface == "averaged" else None
    case = runs._case(plan, b, signal, p.local_index, p.owned, out, weights, E.senders(p.needs, both), copies)
    sets = lambda d: (lambda rows: {a: {k: sorted(r["cell_id"] for r in rows if (r["cluster_id"], r["dim"]) == (a, k)) for k in range(3)} for a in range(3)})(d.collect())
    mixing = {a: {r["dst"]: r["w"] for r in weights.collect() if r["src"] == a} for a in range(3)}
    shared, asked = {(r["src"], r["dst"], r["dim"], r["cell_id"]) for r in both.collect()}, {(r["src"], r["dst"], r["dim"], r["cell_id"]) for r in p.needs.collect()}
    assert any(len(m) == 3 for m in mixing.values()) and shared and asked
    last = {}
    for t in range(7):
        for a in range(3):
            for d in range(3):
                last[a, d, t] = dict(last[a, d, t - 1]) if t and imputer == "hold" else {}
                for src in range(3):
                    for c in range(len(full[d])) if (t + src) % 3 == 1 else ():
                        if (a, src, d, c) in shared:
                            copy = lambda k: full[d][c, t] * (1 + k) + t  # noqa: B023, E731
                            last[a, d, t][c] = 0.5 * (copy(a) + copy(src)) if interface == "averaged" else full[d][c, t]
                        elif (a, src, d, c) in asked:
                            last[a, d, t][c] = full[d][c, t]
    theta, _ = ccvar_loop(plan, sets(p.local_index), sets(p.owned), sets(out), mixing, 1, lambda a, d, t: last[a, d, t], lambda t, a: t % (2 + a) == 0)
    first = runs.folded({5: case}, signal, before=3)
    second = runs.folded({5: case}, signal, L.final_state(first), since=3)
    parts, whole = [{}, {}], runs.learn({5: case}, signal)
    for got, rows in zip(parts, (whole.collect(), L.history(first).collect() + L.history(second).collect()), strict=True):
        for r in rows:
            got.setdefault((r["t"], r["agent"], r["dim"]), {})[r["idx"]] = r["value"]
        assert set(got) == set(theta)
        for k, v in theta.items():
            assert np.allclose([got[k].get(n, np.nan) for n in range(len(v))], v, atol=1e-9), k


def test_folds_of_what_arrived(spark):
    """Receipts, lost messages among them, by a loop over agents; from arrays, from tables, agent by agent, and in two parts."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(8, 4, 6, 3))
    grams, rhs = np.einsum("taif,taig->tafg", x, x), draw.normal(size=(8, 4, 3))
    w = np.array([[0.4, 0.3, 0.3, 0], [0.3, 0.4, 0.3, 0], [0.3, 0.3, 0.4, 0], [0, 0, 0, 1.0]])
    sends = {(t, a) for t in range(8) for a in range(4) if (t + a) % 3 == 0 or t == 4}
    came = [(t, i, j) for t, j in sorted(sends) for i in range(4) if i == j or (w[i, j] and draw.random() < 0.7)]
    rows = lambda a, names: spark.createDataFrame([(*map(int, k), float(a[k])) for k in np.ndindex(a.shape)], names).selectExpr("9L as case_id", "2L as dim", "*")
    g, r = rows(grams, "t long, agent long, f long, g long, val double"), rows(rhs, "t long, agent long, f long, val double")
    mix = spark.createDataFrame([(9, i, j, float(w[i, j])) for i, j in np.ndindex(4, 4) if w[i, j]], "case_id long, src long, dst long, w double")
    got_at = spark.createDataFrame([(9, *k) for k in came], "case_id long, t long, src long, dst long")
    begun = spark.createDataFrame([(9, 2, a, -1, "theta", f, 0.1 * (a + f)) for a in range(3) for f in range(3)], L.FOLDED)
    for rule in (L.Rule(0.9, "kgt", 3, 1.5, 0.7, 0.9, sends="x"), L.Rule(0.8, "kgt", consensus="always", sends="x"), L.Rule(0.9, "atc", consensus="always", sends="x"), L.Rule(0.9, "atc", sends="x")):
        theta, phi, rr, z, c, old = (np.zeros(k) for k in ((4, 3), (4, 3, 3), (4, 3), (4, 3), (4, 3), (4, 3)))
        theta[:3] = [[0.1 * (a + f) for f in range(3)] for a in range(3)]
        want = []
        for t in range(8):
            for a in range(4):
                phi[a], rr[a] = rule.gamma * phi[a] + (1 - rule.gamma) * grams[t, a], rule.gamma * rr[a] + (1 - rule.gamma) * rhs[t, a]
                gradient = phi[a] @ theta[a] - rr[a]
                gradient = rule.c * (gradient + c[a]) if rule.mixing == "kgt" else gradient
                theta[a] = theta[a] - gradient / (1e-4 + np.linalg.eigvalsh(phi[a])[-1])
                if (t, a) in sends:
                    z[a] = (old[a] - theta[a]) / (rule.k * rule.c)
            sent = theta.copy()
            for a in range(4):
                from_ = [j for j in range(4) if j != a and (t, a, j) in came]
                if rule.consensus == "gated" and not from_:
                    continue
                if rule.mixing == "atc":
                    theta[a] = w[a, a] * sent[a] + sum(w[a, j] * sent[j] for j in from_)
                    continue
                kcs = rule.k * rule.c * rule.s
                c[a] = c[a] - z[a] + w[a, a] * z[a] + sum(w[a, j] * z[j] for j in from_)
                theta[a] = w[a, a] * (old[a] - kcs * z[a]) + sum(w[a, j] * (sent[j] - kcs * z[j]) for j in from_)
                old[a] = theta[a]
            want.append(theta.copy())

        def table(x):
            out = np.full((8, 4, 3), np.nan)
            for row in x.collect():
                out[row["t"], row["agent"], row["idx"]] = row["value"]
            return out

        assert np.allclose(table(L.sequential(g, r, mix, {9: rule}, {2: 3}, L.TOGETHER, got_at, begun)), want), rule
        # in two parts; agent by agent over the first steps only
        for together, at, end in {"kgt gated": ((L.TOGETHER, 5, 8), (0, 2, 4)), "atc always": ((0, 2, 3),)}.get(f"{rule.mixing} {rule.consensus}", ()):
            first = L.folded(g.filter(f"t < {at}"), r.filter(f"t < {at}"), mix, {9: rule}, {2: 3}, together, got_at.filter(f"t < {at}"), begun).cache()
            rest = f"t >= {at} and t < {end}"
            second = L.folded(g.filter(rest), r.filter(rest), mix, {9: rule}, {2: 3}, together, got_at.filter(rest), L.final_state(first), ends=False)
            assert np.allclose(table(L.history(first).unionByName(L.history(second)))[:end], want[:end]), (rule, together)
    with pytest.raises(ValueError):
        L.sequential(g, r, mix, {9: rule}, {2: 3})
    with pytest.raises(ValueError):
        presets_with_labels()


def presets_with_labels():
    from cobordia.plans import presets

    presets.Plan(imputer="labels", data_sends="true")


def test_registered_metrics_and_imputers_reach_a_case(spark, b):
    from pyspark.sql import functions as F

    from cobordia.plans import presets, runs

    if "worst" not in registry.names("metric"):

        @F.pandas_udf("double")
        def worst(yhat: pd.Series, y: pd.Series) -> float:
            return float((yhat - y).abs().max())

        registry.register("metric", "worst")(worst)
        registry.register("metric", "bias")(lambda yhat, y: F.avg(yhat - y))
        registry.register("imputer", "ones")(lambda came, blank, last, keys: E.zero_between(came, blank, last, keys).withColumn("x", F.lit(1.0)))
    plan = presets.merged(presets.PRESETS["default"], metrics=("worst", "bias"), imputer="ones", data_clock=3, rule={"mixing": "none"}, model={"dims": (1,)})
    signal = runs.settle(runs.union(readers.from_matrix(spark, m, d).select("dim", "cell_id", "t", "x") for d, m in enumerate((NODES, EDGES, FACES))))
    p = P.partition(b, spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)], "cluster_id long, cell_id long"), 1, 1)
    out = runs.settle(G.partial_indices(p.local_index, p.owned).filter("is_out").select("cluster_id", "dim", "cell_id"))
    case = runs._case(plan, b, signal, p.local_index, p.owned, out, runs._alone(p.owned))
    own = {(r["cluster_id"] * runs.BLOCK + r["cell_id"], r["dim"]) for r in p.owned.collect()}
    x = case.signal.collect()
    assert {r["x"] for r in x if (r["cell_id"], r["dim"]) not in own} == {1.0} and any((r["cell_id"], r["dim"]) not in own for r in x)
    theta = runs.learn({1: case}, signal)
    made = runs.M.with_truth(runs.M.aggregate(runs.forecasts({1: case}, theta)), runs.truth(signal)).toPandas()
    got = {(r["dim"], r["i"]): r for r in runs.scored(signal, {1: case}, theta).collect()}
    for key, g in made.groupby(["dim", "i"]):
        assert abs(got[key]["worst"] - (g.yhat - g.y).abs().max()) < 1e-9 and abs(got[key]["bias"] - (g.yhat - g.y).mean()) < 1e-9
    assert got and {"tv_nmse", "tv_mae", "tv_mape"} <= set(got[key].asDict())
    with pytest.raises(KeyError):
        presets.Plan(metrics=("none such",))


def test_spectral_norms(spark):
    draw = np.random.default_rng(4)
    x = [draw.normal(size=(9, 6)) * 10.0**k for k in range(-2, 3)]
    q = np.linalg.qr(draw.normal(size=(5, 5)))[0]
    matrices = [*(m.T @ m for m in x), (q * [3, 3, 1, 0, 0]) @ q.T, (q * [1, 0.9999, 0.5, 0, 0]) @ q.T, np.zeros((2, 2)), np.full((1, 1), 7.0)]
    rows = [(k, f, g, float(m[f, g])) for k, m in enumerate(matrices) for f, g in np.ndindex(m.shape)]
    got = {r["t"]: r["norm2"] for r in L.spectral_norm(spark.createDataFrame(rows, "t long, f long, g long, val double"), ["t"]).collect()}
    assert np.allclose([got[k] for k in range(len(matrices))], [np.linalg.eigvalsh(m)[-1] for m in matrices], rtol=1e-7)


def test_cases_that_share_their_matrices(spark):
    """Rules and weights of their own over one copy of the matrices give what separate cases give, in either path."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(4, 3, 6, 2))
    grams, rhs = np.einsum("taif,taig->tafg", x, x), draw.normal(size=(4, 3, 2))
    rows = lambda a, case, names: [(case, 2, *map(int, k), float(a[k])) for k in np.ndindex(a.shape)]
    rules = {1: L.Rule(0.9, "atc", 1), 2: L.Rule(0.8, "kgt", 2), 3: L.Rule(0.9), 4: L.Rule(0.9, "atc", 2, consensus="always")}
    weight = {c: np.full((3, 3), 1 / 3) if c < 4 else np.array([[0.5, 0.5, 0], [0.5, 0.3, 0.2], [0, 0.2, 0.8]]) for c in rules}
    g = lambda cases: spark.createDataFrame([r for c in cases for r in rows(grams, c, "")], "case_id long, dim long, t long, agent long, f long, g long, val double")
    r = lambda cases: spark.createDataFrame([r for c in cases for r in rows(rhs, c, "")], "case_id long, dim long, t long, agent long, f long, val double")
    mix = spark.createDataFrame([(c, i, j, float(w[i, j])) for c, w in weight.items() for i, j in np.ndindex(3, 3) if w[i, j]], "case_id long, src long, dst long, w double")
    for together in (L.TOGETHER, 0):
        got = np.full((5, 4, 3, 2), np.nan)
        x = L.history(L.folded(g([1]), r([1]), mix, rules if together else {k: v for k, v in rules.items() if k in (1, 3)}, {2: 2}, together, ends=False, same=dict.fromkeys(rules, 1)))
        for row in x.collect():
            got[row["case_id"], row["t"], row["agent"], row["idx"]] = row["value"]
        for c, rule in rules.items():
            if together or c in (1, 3):
                assert np.allclose(got[c], L.run_fold(grams, rhs, weight[c], rule)), (c, together)
    with pytest.raises(ValueError):
        L.folded(g([1]), r([1]), mix, rules, {2: 2}, same=dict.fromkeys(rules, 1), initial=spark.createDataFrame([], L.FOLDED))


def test_last_message_as_of_each_step(spark):
    inbox = spark.createDataFrame([(1, 2, "owned", 0, 5, t, t * 10) for t in (2, 3, 7)] + [(2, 1, "owned", 0, 6, 9, 1)], "src long, dst long, kind string, dim long, cell_id long, t long, value long")
    now = spark.createDataFrame([(t,) for t in (0, 2, 3, 4, 6, 8)], "t long")
    got = {(r["cell_id"], r["t"]): r["value"] for r in E.fresh(inbox, now, accept_stale=True).collect()}
    assert got == {(5, 2): 20, (5, 3): 30, (5, 4): 30, (5, 6): 30, (5, 8): 70}
    wanted = spark.createDataFrame([(2, 1, 0, 5, t) for t in (1, 2, 5, 9)] + [(1, 2, 0, 6, 9), (4, 4, 0, 1, 1)], "src long, dst long, dim long, cell_id long, t long")
    held = {(r["src"], r["cell_id"], r["t"]): r["value"] for r in E.impute_hold(wanted, inbox).collect()}
    assert held == {(2, 5, 1): 0, (2, 5, 2): 20, (2, 5, 5): 30, (2, 5, 9): 70, (1, 6, 9): 1, (4, 1, 1): 0}


def test_topolms_rollout(b, spark, edge_signal):
    lower, upper = A.lower_laplacian(b[1]), A.upper_laplacian(b[2])
    x = X.topolms(lower, upper, edge_signal, 2).selectExpr("i", "t", "f", "cast(s as double) as s")
    h = np.random.default_rng(2).normal(size=5)
    theta = spark.createDataFrame([(t, f, float(h[f])) for t in range(4) for f in range(5)], "t long, f long, value double")
    dense_x = np.zeros((4, 5, 5))
    for r in x.collect():
        dense_x[r["t"], r["i"], r["f"]] = r["s"]
    got = {(r["t_made"], r["horizon"], r["i"]): r["yhat"] for r in L.topolms_rollout(lower, upper, x, theta, 2, 3).collect()}
    for t in range(4):
        for k in (1, 2, 3):
            want = L.topolms_forecast(dense_x[t], h, B1.T @ B1, B2 @ B2.T, 2, k)
            assert np.allclose([got[t, k, i] for i in range(5)], want)


def test_greedy_modularity_against_all_merges(spark):
    draw = np.random.default_rng(8)
    # the last graph falls into parts; of the second, merging still gains where best communities are left
    for n, best, resolution in ((14, None, 1.0), (18, 9, 0.6), (12, 3, 1.4), (21, 2, 1.0)):
        pairs = {(int(i), int(j)) for i, j in draw.integers(0, n, (3 * n, 2)) if i < j and (n < 21 or i // 6 == j // 6)}
        nodes = sorted({v for p in pairs for v in p})
        m = len(pairs)
        groups = [{v} for v in nodes]
        degree = lambda g: sum((i in g) + (j in g) for i, j in pairs)
        while len(groups) > 1:
            gains = []
            for x in range(len(groups)):
                for y in range(x + 1, len(groups)):
                    between = sum((i in groups[x] and j in groups[y]) or (i in groups[y] and j in groups[x]) for i, j in pairs)
                    if between:
                        a, c = sorted((groups[x], groups[y]), key=min)
                        gains.append((round(2 * (between / (2 * m) - resolution * degree(a) * degree(c) / (2 * m) ** 2), 12), -min(a), -min(c), a, c))
            if not gains:
                break
            gain, _, _, a, c = max(gains, key=lambda g: g[:3])
            if gain < 0 and (best is None or len(groups) <= best):
                break
            groups = [g for g in groups if g not in (a, c)] + [a | c]
        if best == 9:
            assert len(groups) < best
        groups.sort(key=lambda g: (-len(g), min(g)))
        while best is not None and len(groups) > best:
            groups = [groups[0] | groups[1], *groups[2:]]
        want = {frozenset(g) for g in groups}
        graph = spark.createDataFrame([p for i, j in pairs for p in ((i, j), (j, i))], "i long, j long")
        got = {}
        for r in P.greedy_modularity(graph, best, resolution).collect():
            got.setdefault(r["cluster_id"], set()).add(r["cell_id"])
        assert {frozenset(g) for g in got.values()} == want
    with pytest.raises(ValueError):
        P.greedy_modularity(graph, most=3)


def test_label_propagation(spark, b):
    hodge = dense(A.hodge(b, 1), 5)
    local = spark.createDataFrame([(0, 1, c, t, float(3 * c + t)) for c in range(5) for t in range(3)], "cluster_id long, dim long, cell_id long, t long, x double")
    stale = spark.createDataFrame([(0, 1, 3), (0, 1, 4)], "cluster_id long, dim long, cell_id long")
    m = hodge.copy()
    np.fill_diagonal(m, 0.01 * np.diag(hodge) + 1)
    for r in E.propagate_labels(local, A.hodge(b, 1), stale).collect():
        fresh = np.array([0.0 if c in (3, 4) else 3 * c + r["t"] for c in range(5)])
        want = (np.linalg.pinv(m) @ fresh)[r["cell_id"]] if r["cell_id"] in (3, 4) else 3 * r["cell_id"] + r["t"]
        assert abs(r["x"] - want) < 1e-9


def test_labels_by_conjugate_gradients(spark, b):
    """All dimensions, views with nothing, something and everything stale, singular and indefinite matrices: as the inverse."""
    cells = {0: 4, 1: 5, 2: 2}
    heard = {0: {0: {3}, 1: {3, 4}, 2: {1}}, 1: {0: set(range(4)), 1: {0}, 2: set()}}
    for dim, n in cells.items():
        hodge = dense(A.hodge(b, dim), n)
        local = [(k, dim, c, t, float((7 * c + 3 * t + k) % 5)) for k in heard for c in range(n) for t in range(3)]
        stale = spark.createDataFrame([(k, dim, c) for k, x in heard.items() for c in x[dim]], "cluster_id long, dim long, cell_id long")
        m = hodge.copy()
        np.fill_diagonal(m, 0.01 * np.diag(hodge) + 1)
        got = E.propagate_labels(spark.createDataFrame(local, "cluster_id long, dim long, cell_id long, t long, x double"), A.hodge(b, dim), stale, dense=0).collect()
        assert len(got) == len(local)
        x = {row[:4]: row[4] for row in local}
        for r in got:
            k, c, t = r["cluster_id"], r["cell_id"], r["t"]
            fresh = np.array([0.0 if i in heard[k][dim] else x[k, dim, i, t] for i in range(n)])
            want = (np.linalg.pinv(m) @ fresh)[c] if c in heard[k][dim] else x[k, dim, c, t]
            assert abs(r["x"] - want) < 1e-8
    # [[1, -1], [-1, 1]] is singular: the least norm's solution
    pair = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, -1.0), (1, 0, -1.0)], "i long, j long, val double")
    two = spark.createDataFrame([(0, 0, 0, 0, 4.0), (0, 0, 1, 0, 9.0)], "cluster_id long, dim long, cell_id long, t long, x double")
    one = spark.createDataFrame([(0, 0, 1)], "cluster_id long, dim long, cell_id long")
    for most_dense in (0, 4):
        got = {r["cell_id"]: r["x"] for r in E.propagate_labels(two, pair, one, strength=0.0, dense=most_dense).collect()}
        assert got[0] == 4.0 and abs(got[1] + 1.0) < 1e-9
    with pytest.raises(ValueError):
        E.propagate_labels(spark.createDataFrame(local, two.schema), A.hodge(b, 2), stale, dense=0, most=0)


def test_labels_between_exchanges(spark, b):
    """What agents take for others' edges: their values at an exchange, the smoothed labels of their own view between two."""
    from cobordia.plans import presets, runs

    hodge, clock = dense(A.hodge(b, 1), 5), 3
    p = P.partition(b, spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)], "cluster_id long, cell_id long"))
    signal = readers.from_matrix(spark, EDGES, 1)
    x = {(r["cell_id"], r["t"]): r["x"] for r in signal.collect()}
    view, own = ({(r["cluster_id"], r["cell_id"]) for r in d.filter("dim = 1").collect()} for d in (p.local_index, p.owned))
    assert view - own
    plan = presets.merged(presets.Plan(), imputer="labels", data_clock=clock)
    rows = runs.held(signal, p.local_index.select("cluster_id", "dim", "cell_id"), p.owned, plan, b).filter("dim = 1").collect()
    got = {(*divmod(r["cell_id"], runs.BLOCK), r["t"]): r["x"] for r in rows}
    assert len(rows) == len(got) and set(got) == {(k, c, t) for k, c in view for t in {t for _, t in x}}
    for k in {k for k, _ in view}:
        cells = sorted(c for j, c in view if j == k)
        m = hodge[np.ix_(cells, cells)]
        np.fill_diagonal(m, 0.01 * np.diag(m) + 1)
        for t in {t for _, t in x}:
            smooth = np.linalg.pinv(m) @ np.array([x[c, t] if (k, c) in own else 0.0 for c in cells])
            for c, f in zip(cells, smooth, strict=True):
                assert abs(got[k, c, t] - (x[c, t] if (k, c) in own or t % clock == 0 else f)) < 1e-9


def test_views_of_agents(spark, b):
    g = P.only_edges(b)
    listed = P.needed(g["needs"].filter("src = 0"), b)
    assert {(r["dim"], r["cells"]) for r in g["needs"].filter("src = 0").collect()} == {(0, 4), (1, 4), (2, 2)} and listed.count() == 10 and listed.filter("dim = 1 and cell_id = 0").count() == 0
    p = P.partition(b, spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)], "cluster_id long, cell_id long"))
    signal = readers.from_matrix(spark, EDGES, 1)
    view = G.in_equals_out_view(p.local_index, p.owned, b, signal, p.needs)
    own = {(r["cluster_id"], r["dim"], r["cell_id"]) for r in view["index"].collect()}
    assert own >= {(r["cluster_id"], r["dim"], r["cell_id"]) for r in p.owned.collect()}
    assert all((r["cluster_id"], r["dim"], r["j"]) in own and (r["cluster_id"], r["dim"] - 1, r["i"]) in own for r in view["complex"].collect())
    assert view["signal"].count() == 5 * 7 and all((r["src"], r["dim"], r["cell_id"]) in own for r in view["neighbours"].collect())


def test_long_averages_and_scales(spark):
    x = spark.createDataFrame([(0, t, 1.0 + t % 3) for t in range(700)], "f long, t long, val double")
    state = 0.0
    got = {r["t"]: r["val"] for r in X.ewma(x, ["f"], 0.4).collect()}  # beyond 1e100 twice
    for t in range(700):
        state = 0.4 * state + 0.6 * (1.0 + t % 3)
        assert abs(got[t] - state) < 1e-9


def test_presets_merge():
    from cobordia.plans import presets

    p = presets.merged(presets.PRESETS["default"], rule={"clock": 3}, data_clock=2)
    assert (p.rule.clock, p.rule.mixing, p.data_clock) == (3, "atc", 2) and p.model.pair(p.model.powers, 0) == (2, 2)
    assert p.columns()["rule_clock"] == "3" and len(p.model.columns(1, True, True)) == 17
    for bad in ({"data_clock": 0}, {"imputer": "x"}, {"model": {"horizon": 0}}, {"model": {"kind": "x"}}, {"rule": {"consensus": "x"}}):
        with pytest.raises(ValueError):
            presets.merged(p, **bad)


def test_ewma_closed_form(spark):
    x = spark.createDataFrame([(0, t, float(t * t)) for t in range(8)], "f long, t long, val double")
    got = {r["t"]: r["val"] for r in X.ewma(x, ["f"], 0.7).collect()}
    state = 0.0
    for t in range(8):
        state = 0.7 * state + 0.3 * t * t
        assert abs(got[t] - state) < 1e-9


def test_metrics(spark):
    p = spark.createDataFrame([(1, 0, 1, 0, 0, 2.0), (1, 1, 1, 0, 0, 4.0), (1, 0, 1, 1, 0, 0.0)], "case_id long, cluster_id long, dim long, cell_id long, i long, yhat double")
    y = spark.createDataFrame([(1, 0, 0, 3.0), (1, 1, 0, 0.0), (1, 2, 0, 9.0)], "dim long, cell_id long, i long, y double")
    r = M.tv_metrics(M.with_truth(M.aggregate(p), y)).first()
    assert (r["tv_nmse"], r["tv_mae"], r["tv_mape"]) == (0.0, 0.0, 0.0)
    none = M.tv_metrics(M.with_truth(M.aggregate(p), y.selectExpr("dim", "cell_id", "i", "0.0 as y"))).first()
    assert none["tv_nmse"] is None and none["tv_mape"] is None
    one = spark.createDataFrame([(1, 0, 0, 0, 5.0)], "case_id long, agent long, t long, idx long, value double")
    assert M.disagreement(one).first()["self_rms"] == 0.0


def test_hold_is_zero_padding_at_every_step(spark):
    wanted = spark.createDataFrame([(0, 1, 1, 7, t) for t in range(4)], "src long, dst long, dim long, cell_id long, t long")
    sent = spark.createDataFrame([(t, 1, 0, "owned", 1, 7, t + 5) for t in range(4)], "t long, src long, dst long, kind string, dim long, cell_id long, value long")
    assert sorted(E.impute_hold(wanted, sent).collect()) == sorted(E.impute_zero(wanted, sent).collect())
    late = E.impute_hold(wanted, sent.filter("t % 2 = 0")).orderBy("t").collect()
    assert [r["value"] for r in late] == [5, 5, 7, 7]


def test_refusals(b, spark):
    nodes = spark.createDataFrame([(0,)], "node long")
    for f in (
        lambda: A.laplacians({}, 1), lambda: A.laplacians(b, 3), lambda: A.power(b[1], 0), lambda: N.self_adjacency(b[1], -1),
        lambda: P.check_dim(b, 5), lambda: P.clusterheads(b[1], nodes, 0), lambda: P.bfs_clusters(b[1], nodes.limit(0), 1), lambda: P.bfs_clusters(b[1], nodes, 0),
        lambda: P.only_edges({}), lambda: M.persistence(b[1], 0), lambda: L.Rule(mixing="x"), lambda: L.Rule(clock=0), lambda: registry.register("mixing", "atc")(len),
    ):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(KeyError):
        readers.from_arrays(spark, {"s": np.zeros((2, 2))})
    with pytest.raises(KeyError):
        registry.get("mixing", "none")


def test_sources_and_sinks(spark, tmp_path):
    np.savez(tmp_path / "x.npz", s=SIGNAL.T, B1=B1, B2=B2)
    signal, b = readers.from_npz(spark, str(tmp_path / "x.npz"))
    assert signal.count() == 20 and abs(signal.groupBy().sum("x").first()[0]) < 1e-9 and b[2].count() == 6
    assert len(list(readers.replay(signal))) == 4
    signal.write.parquet(str(tmp_path / "signal"))
    readers.from_boundary(spark, B1, 1).unionByName(readers.from_boundary(spark, B2, 2)).write.parquet(str(tmp_path / "b"))
    again, sides = readers.from_parquet(spark, str(tmp_path / "signal"), str(tmp_path / "b"), centred=False)
    assert again.count() == 20 and (dense(A.lower_laplacian(sides[1]), 5) == B1.T @ B1).all()
    m = spark.createDataFrame([(1, 0, t, 0.5 * t) for t in range(3)], "case_id long, dim long, i long, tv_mae double")
    sinks.save_metrics(m, str(tmp_path / "m"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).select("case_id", "dim", "i", "tv_mae").collect())) == [(1, 0, t, 0.5 * t) for t in range(3)]
    t = spark.createDataFrame([("tvMAE", 1.0, None)], "metric string, a double, b double")
    assert sinks.markdown(t).splitlines()[-1] == "| tvMAE | 1.000000e+00 | nan |" and "tvMAE & 1.000000e+00 & nan" in sinks.latex(t)


def test_cases_on_one_view_share_their_operators(spark):
    """Data clocks differ in signals alone; the features of all dimensions in one join are those of each by itself."""
    from pyspark.sql import functions as F

    from cobordia.plans import presets, runs
    from cobordia.plans.fixture import Fixture
    from tests.conftest import SF

    s = runs.Setting(Fixture(spark, SF))
    one, ten = (s.agents(presets.merged(runs.PLAN, data_clock=c, model={"powers": (1, (3, 2), 2)})) for c in (1, 10))
    assert one.boundaries is ten.boundaries and one.targets is ten.targets
    model, b, early = one.plan.model, one.boundaries, one.signal.filter("t < 5")
    own = {d: early.filter(F.col("dim") == d).drop("dim") for d in (0, 1, 2)}
    got = {(r["dim"], r["i"], r["t"], r["f"]): r["s"] for r in one.features.filter("t < 5").collect()}
    want = {}
    for d in (0, 1, 2):
        low, up = model.pair(model.powers, d)
        x = X.ccvar(own[d].select("cell_id").distinct(), own[d], *A.laplacians(b, d), (low, up), model.lag, (b[d], own[d - 1], low) if d else None, (b[d + 1], own[d + 1], up) if d < 2 else None)
        want |= {(d, r["i"], r["t"], r["f"]): r["s"] for r in X.numbered(x, model.columns(d, d in b, d + 1 in b)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 * max(1, abs(v)) for k, v in want.items())


def test_gram_matrices_take_one_shuffle(spark):
    """A row has as many pairs as columns squared; those are summed up where the group is."""
    draw = np.random.default_rng(7).normal(size=(2, 5, 4))
    x = spark.createDataFrame([(t, i, f, float(draw[t, i, f])) for t, i, f in np.ndindex(draw.shape)], "t long, i long, f long, s double")
    gram = A.gram(x, ["t"])
    got = {(r["t"], r["f"], r["g"]): r["val"] for r in gram.collect()}
    assert len(got) == 2 * 4 * 4 and all(abs(v - draw[t, :, f] @ draw[t, :, g]) < 1e-12 for (t, f, g), v in got.items())
    assert gram._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert gram._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_hop_settings_share_and_are_learned_together(spark):
    """Settings that differ in hops are as those made alone, and so are features, parameters and forecasts made in one go."""
    from cobordia.plans import presets, runs
    from cobordia.plans.fixture import Fixture
    from tests.conftest import SF

    f = Fixture(spark, SF)
    one = runs.Setting(f)
    two, alone = runs.Setting(f, presets.Clustering(q_hop=2), like=one), runs.Setting(f, presets.Clustering(q_hop=2))
    assert two.weights is one.weights and two.signal is one.signal and two.made is not one.made
    for name in ("owned", "index", "heard", "weights", "out"):
        mine, theirs = getattr(two, name), getattr(alone, name)
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.select(*mine.columns).collect()))
    with pytest.raises(ValueError):
        runs.Setting(f, presets.Clustering("modularity"), like=one)
    plan = presets.merged(runs.PLAN, data_clock=3, rule={"clock": 2}, model={"dims": (0, 1)})
    cases = runs.ready({1: one.agents(plan, bare=True), 2: two.agents(plan, bare=True)})
    cases[3] = runs.replace(cases[2], plan=presets.merged(plan, rule={"clock": 5}))
    theta = runs.learn(cases, one.signal)
    together = {(r["case_id"], r["cluster_id"], r["dim"], r["cell_id"], r["i"]): r["yhat"] for r in runs.forecasts(cases, theta).collect()}
    single = {2: alone.agents(plan)}
    by_itself = runs.forecasts(single, runs.learn(single, alone.signal)).collect()
    assert by_itself and len(by_itself) == sum(k[0] == 2 for k in together) == sum(k[0] == 3 for k in together)
    for r in by_itself:
        key = (r["case_id"], r["cluster_id"], r["dim"], r["cell_id"], r["i"])
        assert abs(together[key] - r["yhat"]) < 1e-9 * max(1, abs(r["yhat"]))
    assert any(abs(together[k] - together[3, *k[1:]]) > 1e-6 for k in together if k[0] == 2)
