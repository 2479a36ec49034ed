"""Online learners: what depends on data alone is computed set-wise, and only parameters are folded over time.

A step of any learner here needs, per agent and dimension, the F x F matrix SᵀRS and the vector Sᵀy of its features S
and targets y. Those come from joins and sums over the whole timeline. Dimensions have parameters, states and step
sizes of their own, and mixing is element by element, so each is folded for itself.

Agents that exchange nothing are folded in a group each. Those that do are folded together, all agents of a case and
dimension in one group, as long as their matrices have at most ``TOGETHER`` numbers; that is counted first. Beyond it
each stretch between two exchanges is folded in a group per agent, and the exchange is a join on the sparse weights
(``stepwise``): a settled table for each exchange, and no group that grows with the agents.

Who mixes with whom is the same clock for all, or a table of receipts (t, src, dst): the parameters of ``dst`` arrived at
``src`` at that step; oneself as both says that one sent. A fold can start from a state, its own at an earlier step or
initial parameters alone, so a timeline that grows is folded where it is new.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobordia.operators import consensus as C
from cobordia.session import settle

THETA = "case_id long, dim long, agent long, t long, idx long, value double"
#: Parameters after each step have the part "step"; what a fold ends with has a part for each of ``Fold.NAMES``.
FOLDED = "case_id long, dim long, agent long, t long, part string, idx long, value double"
STATE = "agent long, theta array<double>, phi array<double>, r array<double>, history array<double>, correction array<double>, z array<double>, path array<struct<t:long,theta:array<double>>>"
TOGETHER = 1 << 25
Weights = np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Rule:
    """How a case learns: forgetting ``gamma`` (0: the current step only), ``mixing`` "none", "atc" or "kgt" every
    ``clock`` steps, K-GT's constants, Lasso threshold and a factor of the step size.

    ``consensus``: "gated" agents mix when parameters of a neighbour arrived at that step, "always" at every step with
    what arrived (nothing between two ticks: only their own share is left), "never" not at all.

    ``sends``: in place of the clock, a condition in SQL on (t, agent): does the agent send its parameters at that step.
    """

    gamma: float = 0.98
    mixing: str = "none"
    clock: int = 10
    k: float = 1.0
    c: float = 1.0
    s: float = 1.0
    threshold: float = 0.0
    eta: float = 1.0
    consensus: str = "gated"
    sends: str | None = None

    def __post_init__(self) -> None:
        if self.mixing not in ("none", "atc", "kgt"):
            raise ValueError(f"no mixing {self.mixing}")
        if self.consensus not in ("always", "gated", "never"):
            raise ValueError(f"no consensus {self.consensus}")
        if self.clock < 1:
            raise ValueError("a clock ticks every step or less often")


def step_size(phi: np.ndarray) -> np.ndarray:
    """1 / (1e-4 + largest eigenvalue) of each matrix."""
    return 1.0 / (1e-4 + np.linalg.eigvalsh(phi)[..., -1])


def spectral_norm(grams: DataFrame, by: list[str], tolerance: float = 1e-9, most: int = 40) -> DataFrame:
    """(by, norm2): the largest eigenvalue of each symmetric positive matrix (by, f, g, val), which is the squared spectral
    norm of X where val is XᵀX.

    Power iteration with the matrix itself for a start: each round squares all of them, scaled to trace 1, so round k stands
    for 2^k plain ones, and takes the mean of the eigenvalues by their powers. It stops when no mean moved by more than
    ``tolerance`` of itself. Zero matrices have norm 0. A round is a join and a sum over entries, whatever the number of
    matrices; nothing but the largest movement comes to the driver.
    """
    a = settle(grams.groupBy(*by, "f", "g").agg(F.sum(F.col("val").cast("double")).alias("val")))

    def scaled(m: DataFrame) -> DataFrame:
        trace = m.groupBy(*by).agg(F.sum(F.when(F.col("f") == F.col("g"), F.col("val")).otherwise(0.0)).alias("trace"))
        return m.join(trace.filter("trace > 0"), by).select(*by, "f", "g", (F.col("val") / F.col("trace")).alias("val"))

    m, mean = settle(scaled(a)), None
    for _ in range(most):
        now = settle(a.join(m.withColumnRenamed("val", "share"), [*by, "f", "g"]).groupBy(*by).agg(F.sum(F.col("val") * F.col("share")).alias("norm2")))
        if mean is not None:
            moved = now.join(mean.withColumnRenamed("norm2", "before"), by).agg(F.max(F.abs(F.col("norm2") - F.col("before")) / F.col("norm2"))).first()[0]
            if moved is None or moved <= tolerance:
                break
        mean = now
        left, right = m.select(*by, "f", F.col("g").alias("k"), F.col("val").alias("x")), m.select(*by, F.col("f").alias("k"), "g", F.col("val").alias("y"))
        m = settle(scaled(left.join(right, [*by, "k"]).groupBy(*by, "f", "g").agg(F.sum(F.col("x") * F.col("y")).alias("val"))))
    return a.select(*by).distinct().join(now, by, "left").select(*by, F.coalesce("norm2", F.lit(0.0)).alias("norm2"))


class Fold:
    """Parameters and states of some agents, and their steps; rows are agents."""

    NAMES = ("theta", "phi", "r", "history", "correction", "z")

    def __init__(self, agents: int, width: int, rule: Rule) -> None:
        self.rule = rule
        self.theta, self.r, self.history, self.correction, self.z = (np.zeros((agents, width)) for _ in range(5))
        self.phi = np.zeros((agents, width, width))

    def local(self, gram: np.ndarray, rhs: np.ndarray) -> None:
        rule = self.rule
        self.phi = rule.gamma * self.phi + (1 - rule.gamma) * gram
        self.r = rule.gamma * self.r + (1 - rule.gamma) * rhs
        gradient = np.einsum("aij,aj->ai", self.phi, self.theta) - self.r
        if rule.mixing == "kgt":
            gradient = rule.c * (gradient + self.correction)
        self.theta = self.theta - rule.eta * step_size(self.phi)[:, None] * gradient
        if rule.threshold:
            self.theta = np.sign(self.theta) * np.maximum(np.abs(self.theta) - rule.threshold, 0)

    def send(self, sent: np.ndarray) -> None:
        """What the agents ``sent`` (a column) prepare before they send."""
        if self.rule.mixing == "kgt":
            self.z = np.where(sent, (self.history - self.theta) / (self.rule.k * self.rule.c), self.z)

    def mix(self, own: np.ndarray, others, who: np.ndarray) -> None:
        """One consensus of the agents ``who``: ``own`` weights (a column), ``others(x)`` the weighted sum of what came."""
        rule = self.rule
        if rule.mixing == "atc":
            self.theta = np.where(who, own * self.theta + others(self.theta), self.theta)
            return
        kcs = rule.k * rule.c * rule.s
        theta = own * (self.history - kcs * self.z) + others(self.theta - kcs * self.z)
        self.correction = np.where(who, self.correction - self.z + own * self.z + others(self.z), self.correction)
        self.theta = np.where(who, theta, self.theta)
        self.history = np.where(who, theta, self.history)


def _nothing(x: np.ndarray) -> np.ndarray:
    return np.zeros_like(x)


Arrivals = dict[int, tuple[np.ndarray, np.ndarray]]


def run_fold(grams: np.ndarray, rhs: np.ndarray, weights: Weights, rule: Rule, times: list[int] | None = None, arrivals: Arrivals | None = None, fold: Fold | None = None) -> np.ndarray:
    """θ after each step, (T, agents, F), from (T, agents, F, F) and (T, agents, F) and mixing weights: a matrix (row:
    receiver), or its entries (receiver, sender, weight). ``times``: the steps' numbers, 0, 1, ... by default.
    ``arrivals``: step -> (receivers, senders), in place of the rule's clock; ``fold``: a state to start from, and to be
    left in the last one."""
    steps, agents, width = rhs.shape
    if isinstance(weights, np.ndarray):
        weights = (*np.nonzero(weights), weights[np.nonzero(weights)])
    src, dst, w = weights
    own = np.zeros((agents, 1))
    own[src[src == dst], 0] = w[src == dst]
    src, dst, w = src[src != dst], dst[src != dst], w[src != dst]
    every, nobody = np.ones((agents, 1), bool), np.zeros(0, np.int64)
    place = {pair: k for k, pair in enumerate(zip(src.tolist(), dst.tolist(), strict=True))} if arrivals is not None else {}

    def came(t: int) -> tuple[np.ndarray, np.ndarray]:
        """The links over which parameters arrive at a step, and who sends."""
        if arrivals is None:
            ticks = t % rule.clock == 0
            return (np.arange(len(src)) if ticks else nobody), np.full((agents, 1), ticks)
        got = list(zip(*(x.tolist() for x in arrivals[t]), strict=True)) if t in arrivals else []
        links = [place[pair] for pair in got if pair in place]
        return np.asarray(links, np.int64), np.isin(np.arange(agents), [j for _, j in got])[:, None]

    fold, out = fold or Fold(agents, width, rule), np.empty((steps, agents, width))
    for n, t in enumerate(times if times is not None else range(steps)):
        fold.local(grams[n], rhs[n])
        if rule.mixing != "none" and rule.consensus != "never":
            links, sent = came(t)
            fold.send(sent)

            def others(x: np.ndarray, links: np.ndarray = links) -> np.ndarray:
                out = np.zeros_like(x)
                np.add.at(out, src[links], w[links, None] * x[dst[links]])
                return out

            if rule.consensus == "always" or len(links):
                fold.mix(own, others, np.isin(np.arange(agents), src[links])[:, None] if rule.consensus == "gated" else every)
        out[n] = fold.theta
    return out


def _dense(cells, into: np.ndarray) -> None:
    if cells is not None:
        for e in cells:
            into[e["k"]] = e["v"]


def _long(case: int, dim: int, agents: list, times: list, part: str, x: np.ndarray) -> pd.DataFrame:
    """(FOLDED) of x by step, agent and place."""
    t, n, f = np.indices(x.shape).reshape(3, -1)
    return pd.DataFrame({"case_id": case, "dim": dim, "agent": np.asarray(agents)[n], "t": np.asarray(times)[t], "part": part, "idx": f, "value": x.ravel()})


def _states(case: int, dim: int, agents: list, t: int, fold: Fold) -> list[pd.DataFrame]:
    return [_long(case, dim, agents, [t], name, getattr(fold, name).reshape(1, len(agents), -1)) for name in Fold.NAMES]


def _started(fold: Fold, at: int, entries) -> None:
    """Put an agent's state (part, idx, value) into the fold."""
    for e in entries if entries is not None else ():
        getattr(fold, e["part"])[at].reshape(-1)[e["idx"]] = e["value"]


def sequential(grams: DataFrame, rhs: DataFrame, weights: DataFrame, rules: dict[int, Rule], width: int | dict[int, int], together: int = TOGETHER, receipts: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(THETA) of every case: ``folded`` without the state it ends in."""
    return history(folded(grams, rhs, weights, rules, width, together, receipts, initial, ends=False))


def history(x: DataFrame) -> DataFrame:
    """(THETA) of what ``folded`` gives."""
    return x.filter("part = 'step'").drop("part")


def final_state(x: DataFrame) -> DataFrame:
    """(FOLDED) of the last step of each agent, from which ``folded`` goes on."""
    return x.filter("part <> 'step'")


def folded(grams: DataFrame, rhs: DataFrame, weights: DataFrame, rules: dict[int, Rule], width: int | dict[int, int], together: int = TOGETHER, receipts: DataFrame | None = None, initial: DataFrame | None = None, ends: bool = True, same: dict[int, int] | None = None) -> DataFrame:
    """(FOLDED) of every case. ``grams``: (case_id, dim, agent, t, f, g, val); ``rhs``: (case_id, dim, agent, t, f, val);
    ``weights``: (case_id, src, dst, w). Steps are those of ``rhs``; entries without a row are 0. ``width``: features, of
    each dimension if they differ. ``receipts``: (case_id, t, src, dst), for cases whose rule has no clock (``sends``);
    ``initial``: (FOLDED) states to start from, or only parts of them, as ``theta``; all else is 0. ``ends``: are final
    states wanted. ``same``: case -> the case whose matrices it has too, so that cases which differ in rules and weights
    alone are folded over one copy of them; such cases start from 0."""
    widths = {d: width for d in range(3)} if isinstance(width, int) else width
    keys = ["case_id", "dim", "agent", "t"]
    wide = F.element_at(F.create_map(*(F.lit(int(x)) for kv in widths.items() for x in kv)), F.col("dim").cast("int"))
    # a step's matrix as one row: at most width * width entries
    a = grams.groupBy(*keys).agg(F.collect_list(F.struct((F.col("f") * wide + F.col("g")).cast("int").alias("k"), F.col("val").cast("double").alias("v"))).alias("gram"))
    b = rhs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("f").cast("int").alias("k"), F.col("val").cast("double").alias("v"))).alias("rhs"))
    rows = b.join(a, keys, "left")
    start = F.lit(None).cast("array<struct<part:string,idx:int,value:double>>")
    if initial is not None:
        # an agent's state, as large as two of its steps, comes with its first step
        begun = initial.filter(F.col("part").isin(*Fold.NAMES) & (F.col("value") != 0)).groupBy("case_id", "dim", "agent").agg(F.collect_list(F.struct("part", F.col("idx").cast("int").alias("idx"), "value")).alias("state"))
        first = rhs.groupBy("case_id", "dim", "agent").agg(F.min("t").alias("t")).join(begun, ["case_id", "dim", "agent"])
        rows, start = rows.join(first, keys, "left"), F.col("state")
    rows = settle(rows.withColumn("state", start))
    none = [c for c, r in rules.items() if r.mixing == "none" or r.consensus == "never"]
    if receipts is None and any(r.sends for c, r in rules.items() if c not in none):
        raise ValueError("a rule that says who sends needs receipts")
    base = {c: (same or {}).get(c, c) for c in rules}
    if initial is not None and any(c != b for c, b in base.items()):
        raise ValueError("cases that share their matrices start from 0")
    alone_of, meet_of = ({b: [c for c in rules if base[c] == b and (c in none) == kind] for b in {base[c] for c in rules if (c in none) == kind}} for kind in (True, False))

    def fold(steps: pd.DataFrame, mix: pd.DataFrame, of: dict[int, list[int]]) -> pd.DataFrame:
        if steps.empty:
            return pd.DataFrame({n.split()[0]: [] for n in FOLDED.split(", ")})
        return pd.concat([one(case, steps, mix[mix.of == case]) for case in of[int(steps.case_id.iloc[0])]])

    def one(case: int, steps: pd.DataFrame, mix: pd.DataFrame) -> pd.DataFrame:
        dim = int(steps.dim.iloc[0])
        n, rule = widths[dim], rules[case]
        agents, times = sorted(steps.agent.unique()), sorted(steps.t.unique())
        place, when = {a: k for k, a in enumerate(agents)}, {t: k for k, t in enumerate(times)}
        g, r = np.zeros((len(times), len(agents), n * n)), np.zeros((len(times), len(agents), n))
        kept = Fold(len(agents), n, rule)
        for row in steps.itertuples():
            at = when[row.t], place[row.agent]
            _dense(row.gram, g[at])
            _dense(row.rhs, r[at])
            _started(kept, place[row.agent], row.state)
        mix = mix[mix.src.isin(place) & mix.dst.isin(place)]
        src, dst = (np.asarray([place[x] for x in mix[c]], np.int64) for c in ("src", "dst"))
        known = ~mix.w.isna().to_numpy() if len(mix) else np.zeros(0, bool)
        w = (src[known], dst[known], mix.w.to_numpy(float)[known]) if known.any() else np.eye(len(agents))
        arrivals: Arrivals | None = None
        if rule.sends:
            came: dict[int, list[tuple[int, int]]] = {}
            for i, j, steps_ in zip(src.tolist(), dst.tolist(), mix.came, strict=True):
                for t in steps_ if steps_ is not None else ():
                    came.setdefault(int(t), []).append((i, j))
            arrivals = {t: tuple(np.asarray(pairs, np.int64).T) for t, pairs in came.items()}
        theta = run_fold(g.reshape(len(times), len(agents), n, n), r, w, rule, times, arrivals, kept)
        out = [_long(case, dim, agents, times, "step", theta)]
        return pd.concat(out + (_states(case, dim, agents, times[-1], kept) if ends else []))

    out = []
    if none:
        nobody = pd.DataFrame({"of": [], "src": [], "dst": [], "w": [], "came": []})
        alone = rows.filter(F.col("case_id").isin(list(alone_of))).groupBy("case_id", "dim", "agent")
        out.append(alone.applyInPandas(lambda steps: fold(steps, nobody, alone_of), FOLDED))
    if len(none) < len(rules):
        meet = rows.filter(F.col("case_id").isin(list(meet_of)))
        sizes = {(r["case_id"], r["dim"]): r["n"] for r in meet.groupBy("case_id", "dim").agg(F.count("*").alias("n")).collect()}  # cases by dimensions
        large = [k for k, n in sizes.items() if n * widths[k[1]] ** 2 > together]
        for case, dim in large:
            own = meet.filter((F.col("case_id") == case) & (F.col("dim") == dim))
            for c in meet_of[case]:
                came = receipts.filter(F.col("case_id") == c) if rules[c].sends else None
                out.append(stepwise(own, weights.filter(F.col("case_id") == c), rules[c], widths[dim], c, dim, came, ends))
        if len(large) < len(sizes):
            for case, dim in large:
                meet = meet.filter((F.col("case_id") != case) | (F.col("dim") != dim))
            dims = rows.sparkSession.createDataFrame([k for k in sorted(sizes) if k not in large], "case_id long, dim long")
            never = F.lit(None).cast("array<long>")
            mixes = weights.select("case_id", "src", "dst", "w")
            if receipts is None:
                mixes = mixes.withColumn("came", never)
            else:  # a link's steps are at most a timeline; a sender's own pair may have no weight
                links = receipts.groupBy("case_id", "src", "dst").agg(F.collect_list(F.col("t").cast("long")).alias("came"))
                mixes = mixes.join(links, ["case_id", "src", "dst"], "full")
            shares = F.create_map(*(F.lit(int(x)).cast("long") for kv in base.items() for x in kv))
            mixes = mixes.withColumnRenamed("case_id", "of").withColumn("case_id", F.element_at(shares, F.col("of")))
            mixes = mixes.join(F.broadcast(dims), "case_id")  # cases by dimensions
            out.append(meet.groupBy("case_id", "dim").cogroup(mixes.groupBy("case_id", "dim")).applyInPandas(lambda a, b: fold(a, b, meet_of), FOLDED))
    empty = rows.limit(0).selectExpr("case_id", "dim", "agent", "t", "'step' as part", "0L as idx", "0D as value")
    return reduce(DataFrame.unionByName, out) if out else empty


def _gathered(parts: list[DataFrame], most: int = 24) -> list[DataFrame]:
    """``parts``, written as one table whenever there are ``most``, so that no plan grows with the timeline."""
    return [settle(reduce(DataFrame.unionByName, parts))] if len(parts) >= most else parts


def stepwise(rows: DataFrame, weights: DataFrame, rule: Rule, width: int, case: int, dim: int, receipts: DataFrame | None = None, ends: bool = False) -> DataFrame:
    """(FOLDED) of one case and dimension: a group per agent between two exchanges, and a join on the weights at each."""
    weights = settle(weights.select("src", "dst", "w"))
    own = weights.filter("src = dst").select(F.col("src").alias("agent"), F.col("w").alias("own"))
    rows = settle(rows.select("agent", "t", "rhs", "gram", "state").join(own, "agent", "left"))
    times = sorted(r["t"] for r in rows.select("t").distinct().collect())  # a timeline
    if receipts is not None:
        receipts = settle(receipts.select("t", "src", "dst"))
        meets = {r["t"] for r in receipts.select("t").distinct().collect()}  # at most a timeline
    else:
        meets = {t for t in times if t % rule.clock == 0}
    shapes = {n: (width, width) if n == "phi" else (width,) for n in Fold.NAMES}

    def stretch(steps: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        fold, path = Fold(1, width, rule), []
        for name in Fold.NAMES if len(state) else ():
            setattr(fold, name, np.asarray(state[name].iloc[0]).reshape(1, *shapes[name]))
        for row in steps.sort_values("t").itertuples():
            g, r = np.zeros(width * width), np.zeros(width)
            _dense(row.gram, g)
            _dense(row.rhs, r)
            _started(fold, 0, row.state)
            fold.local(g.reshape(1, width, width), r[None])
            if rule.consensus == "always" and row.t not in meets:
                fold.mix(np.asarray([[0.0 if pd.isna(row.own) else row.own]]), _nothing, np.ones((1, 1), bool))
            path.append({"t": int(row.t), "theta": fold.theta[0].tolist()})
        agent = steps.agent.iloc[0] if len(steps) else state.agent.iloc[0]
        return pd.DataFrame([{"agent": agent, **{n: getattr(fold, n).ravel().tolist() for n in Fold.NAMES}, "path": path}])

    def vector(state: DataFrame, name: str) -> DataFrame:
        return state.select("agent", F.posexplode(name).alias("idx", "value"))

    def packed(x: DataFrame) -> DataFrame:
        return x.groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("packed"))

    state = rows.sparkSession.createDataFrame([], STATE)
    out, first = [], 0
    for n, t in enumerate(times):
        if t not in meets and n + 1 < len(times):
            continue
        lot = rows.filter(F.col("t").between(times[first], t))
        state = settle(lot.groupBy("agent").cogroup(state.groupBy("agent")).applyInPandas(lambda a, b: stretch(a, b), STATE))
        moved = state.select("agent", F.explode("path").alias("p")).select("agent", "p.t", F.posexplode("p.theta").alias("idx", "value"))
        first = n + 1
        if t not in meets:
            out.append(moved)
            continue
        out.append(moved.filter(F.col("t") < t))
        # the step's weights: what arrived, and one's own share
        if receipts is None:
            came, sent = weights, state.select("agent")
        else:
            now = receipts.filter(F.col("t") == t)
            came = weights.filter("src = dst").unionByName(weights.filter("src <> dst").join(now, ["src", "dst"], "left_semi"))
            sent = now.select(F.col("dst").alias("agent")).distinct()
        heard = state.select("agent") if rule.consensus == "always" else came.filter("src <> dst").select(F.col("src").alias("agent")).distinct()
        theta = vector(state, "theta")
        if rule.mixing == "atc":
            mixed = {"theta": C.mix_atc(came, theta)}
        else:
            made = packed(C.kgt_aux(theta, vector(state, "history"), rule.k, rule.c).join(sent, "agent", "left_semi"))
            state = settle(state.join(made, "agent", "left").withColumn("z", F.coalesce(F.col("packed.value"), F.col("z"))).drop("packed"))
            z = vector(state, "z")
            new = C.kgt_mix(came, theta, vector(state, "history"), z, rule.k, rule.c, rule.s)
            mixed = {"theta": new, "history": new, "correction": C.kgt_correction(vector(state, "correction"), z, came)}
        for name, table in mixed.items():
            state = state.join(packed(table.join(heard, "agent", "left_semi")), "agent", "left").withColumn(name, F.coalesce(F.col("packed.value"), F.col(name))).drop("packed")
        state = settle(state.withColumn("path", F.lit(None).cast("array<struct<t:long,theta:array<double>>>")))
        out = _gathered([*out, state.select("agent", F.lit(t).cast("long").alias("t"), F.posexplode("theta").alias("idx", "value"))])
    out = [x.withColumn("part", F.lit("step")) for x in out]
    if ends:
        out += [vector(state, n).withColumn("t", F.lit(times[-1]).cast("long")).withColumn("part", F.lit(n)) for n in Fold.NAMES]
    x = reduce(DataFrame.unionByName, out)
    return x.select(F.lit(case).cast("long").alias("case_id"), F.lit(dim).cast("long").alias("dim"), "agent", F.col("t").cast("long").alias("t"), "part", F.col("idx").cast("long").alias("idx"), "value")


def predict(features: DataFrame, theta: DataFrame, same: dict[int, int] | None = None) -> DataFrame:
    """One-step forecasts: features (case_id, dim, agent, cell_id, t, f, s) of step t with the parameters of step t - 1.
    ``same``: case -> the case whose features it has too, of all cases wanted, so that those are there once."""
    of = F.col("case_id") if same is None else F.element_at(F.create_map(*(F.lit(int(x)).cast("long") for kv in same.items() for x in kv)), F.col("case_id"))
    x = theta.select(of.alias("of"), "case_id", "dim", "agent", (F.col("t") + 1).alias("t"), F.col("idx").alias("f"), "value")
    joined = features.withColumnRenamed("case_id", "of").join(x, ["of", "dim", "agent", "t", "f"])
    return joined.groupBy("case_id", "dim", "agent", "cell_id", "t").agg(F.sum(F.col("s") * F.col("value")).alias("yhat"))


def rollout(operator: DataFrame, buffer: DataFrame, theta: DataFrame, biases: dict[int, int], lag: int, horizon: int) -> DataFrame:
    """CC-VAR forecasts (dim, i, t_made, horizon, yhat) of all dimensions, from all steps at once.

    ``operator``: (dim, i, of, j, base, val), the entries by which cell j of dimension ``of`` enters the features base,
    base + 1, ... of cell i, one for each lag; ``buffer``: (dim, i, t, lag, x) with lag 1 the value at t; ``theta``: (dim,
    i, t, f, value), each cell's parameters after step t; ``biases``: dim -> number of the constant feature. Each round
    turns the buffers into features, predicts every cell with the parameters of step t, and shifts the predictions in; a
    round is a few joins whatever the number of steps.
    """
    if horizon < 1:
        raise ValueError("the horizon must be 1 or more")
    out, theta, operator = [], settle(theta), settle(operator)
    at = F.element_at(F.create_map(*(F.lit(int(x)) for kv in biases.items() for x in kv)), F.col("dim").cast("int")) if biases else F.lit(-1)
    constant = theta.filter(F.col("f") == at).select("dim", "i", "t", F.col("value").alias("b"))
    for h in range(1, horizon + 1):
        held = buffer.select(F.col("dim").alias("of"), F.col("i").alias("j"), "t", "lag", "x")
        x = operator.join(held, ["of", "j"]).select("dim", "i", "t", (F.col("base") + F.col("lag") - 1).alias("f"), (F.col("val") * F.col("x")).alias("s"))
        y = x.join(theta, ["dim", "i", "t", "f"]).groupBy("dim", "i", "t").agg(F.sum(F.col("s") * F.col("value")).alias("y"))
        cells = buffer.filter("lag = 1").select("dim", "i", "t")
        y = cells.join(y, ["dim", "i", "t"], "left").join(constant, ["dim", "i", "t"], "left")
        y = settle(y.select("dim", "i", "t", (F.coalesce("y", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("x")))
        out.append(y.select("dim", "i", F.col("t").alias("t_made"), F.lit(h).cast("long").alias("horizon"), F.col("x").alias("yhat")))
        older = buffer.filter(F.col("lag") < lag).select("dim", "i", "t", (F.col("lag") + 1).alias("lag"), "x")
        buffer = settle(older.unionByName(y.select("dim", "i", "t", F.lit(1).cast("long").alias("lag"), "x")))
    return reduce(DataFrame.unionByName, out)


def topolms_forecast(x: np.ndarray, h: np.ndarray, lower: np.ndarray, upper: np.ndarray, m: int, steps: int) -> np.ndarray:
    """Topo-LMS forecast ``steps`` ahead: its own predictions are rolled into the regressors, the last one returned."""
    if steps < 1:
        raise ValueError("the horizon must be 1 or more")
    up, down = x[:, : m + 1], x[:, m + 1 :]
    for _ in range(steps - 1):
        y = np.concatenate((up, down), axis=1) @ h
        up = np.column_stack(((upper @ up)[:, 1:], y))
        down = lower @ np.column_stack((down[:, 1:], y)) if m else down
    return np.concatenate((up, down), axis=1) @ h


def topolms_rollout(lower: DataFrame, upper: DataFrame, regressors: DataFrame, theta: DataFrame, m: int, horizon: int) -> DataFrame:
    """``topolms_forecast`` of one agent as joins, from all steps at once: (i, t_made, horizon, yhat).

    ``regressors``: (i, t, f, s) after step t; ``theta``: (t, f, value). Each round multiplies the upper features by the
    upper Laplacian and the lower ones, with the prediction, by the lower one.
    """
    if horizon < 1:
        raise ValueError("the horizon must be 1 or more")
    x, out = settle(regressors.select("i", "t", "f", "s")), []
    for h in range(1, horizon + 1):
        y = settle(x.join(theta, ["t", "f"]).groupBy("i", "t").agg(F.sum(F.col("s") * F.col("value")).alias("s")))
        out.append(y.select("i", F.col("t").alias("t_made"), F.lit(h).cast("long").alias("horizon"), F.col("s").alias("yhat")))
        if h == horizon:
            break

        def moved(matrix: DataFrame, rows: DataFrame) -> DataFrame:
            held = rows.select(F.col("i").alias("j"), "t", "f", "s")
            return matrix.join(held, "j").groupBy("i", "t", "f").agg(F.sum(F.col("val") * F.col("s")).alias("s"))

        parts = [y.select("i", "t", F.lit(m).cast("long").alias("f"), "s")]
        if m:
            shifted = x.filter(F.col("f").between(1, m)).withColumn("f", F.col("f") - 1)
            newer = x.filter(F.col("f") > m + 1).withColumn("f", F.col("f") - 1).unionByName(y.select("i", "t", F.lit(2 * m).cast("long").alias("f"), "s"))
            parts += [moved(upper, shifted), moved(lower, newer)]
        x = settle(reduce(DataFrame.unionByName, parts))
    return reduce(DataFrame.unionByName, out)
