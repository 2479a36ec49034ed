"""Experiments: learners on whole, local and distributed agents, and what they are compared by.

Runners read a ``presets.Plan``: clustering, dimensions and powers of the model, smoothing, normalisation, horizon,
clocks, imputer, mixing. All agents of a case are one block-diagonal complex: a cell of cluster c has the id c * 2^32 +
cell_id, so one set of joins makes the features of every agent. Each dimension's signal is scaled by its standard
deviation. Months run over the whole timeline.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobordia.functions import registry
from cobordia.operators import agents as G
from cobordia.operators import exchange as E
from cobordia.operators import features as X
from cobordia.operators import incidence as A
from cobordia.operators import learning as L
from cobordia.operators import metrics as M
from cobordia.operators import partition as P
from cobordia.plans import presets
from cobordia.plans.fixture import Fixture
from cobordia.plans.presets import PRESETS, Plan, merged
from cobordia.session import settle

QUERIES, SQL = {}, {}
BLOCK = 1 << 32


def query(name: str):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        return f

    return put


def _block(cluster: str, cell: str):
    return F.col(cluster) * F.lit(BLOCK) + F.col(cell)


def _agent(column: str):
    return F.floor(F.col(column) / BLOCK)


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Case:
    """A case ready to learn: block-diagonal boundaries and signal (dim, cell_id, t, x) of its agents, features (dim, i,
    t, f, s; None until ``ready``), cells that are predicted (dim, i), mixing weights, and widths of the dimensions."""

    plan: Plan
    boundaries: dict[int, DataFrame]
    signal: DataFrame
    features: DataFrame | None
    targets: DataFrame
    weights: DataFrame
    widths: dict[int, int]
    whole: bool = False


def scaled(f: Fixture) -> DataFrame:
    """(dim, cell_id, t, x): each dimension over its standard deviation."""
    s = f.signal()
    sd = F.broadcast(s.groupBy("dim").agg(F.stddev_pop("x").alias("sd")))  # a row per dimension
    return settle(s.join(sd, "dim").select("dim", "cell_id", "t", (F.col("x") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("x")))


def agent_boundaries(boundaries: dict[int, DataFrame], view: DataFrame) -> dict[int, DataFrame]:
    """The boundaries cut to each cluster's view (cluster_id, dim, cell_id), as one block-diagonal complex."""
    cut = settle(P.local_complex(boundaries, view))
    return {k: cut.filter(F.col("dim") == k).select(_block("cluster_id", "i").alias("i"), _block("cluster_id", "j").alias("j"), "val") for k in boundaries}


def held(signal: DataFrame, view: DataFrame, owned: DataFrame, plan: Plan, boundaries: dict[int, DataFrame], heard: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """Each cluster's signal (dim, cell_id, t, x) on block ids: its own values at once, others as they arrive and are
    imputed between two exchanges.

    ``heard``: from whom a cluster hears of a cell (``exchange.senders``); without it, of all at the same steps. ``copies``:
    what clusters see of shared cells themselves (``exchange.interface_copies``), to be averaged at each exchange.
    """
    keys, clock = ["cluster_id", "dim", "cell_id"], plan.data_clock
    own = owned.select(*keys, F.lit(True).alias("own"))
    x = view.select(*keys).join(own, keys, "left")
    if clock == 1 and plan.data_sends is None and copies is None:
        x = x.join(signal, ["dim", "cell_id"])
        return settle(x.select("dim", _block("cluster_id", "cell_id").alias("cell_id"), "t", F.col("x").cast("double").alias("x")))
    others = settle(x.filter("own is null").select(*keys))
    mine = x.filter("own").join(signal, ["dim", "cell_id"]).select(*keys, "t", F.col("x").cast("double").alias("x"))
    if heard is None:
        heard = others.select("cluster_id", F.lit(-1).cast("long").alias("src"), F.lit("owned").alias("kind"), "dim", "cell_id")
    sends = F.expr(plan.data_sends) if plan.data_sends else E.fires(clock)
    came = E.exchanged(heard.join(others, keys, "left_semi"), signal, sends, None if copies is None else copies.withColumnRenamed("src", "cluster_id").join(others, keys, "left_semi").withColumnRenamed("cluster_id", "src"))
    span = F.broadcast(signal.agg(F.min("t").alias("first"), F.max("t").alias("last")))  # one row
    # before anything came there is 0, from the first step on
    blank = others.join(span, how="cross").select(*keys, F.col("first").alias("t"), F.lit(0.0).alias("value"), F.lit(0).alias("real"))
    came = came.withColumn("real", F.lit(1)).unionByName(blank).groupBy(*keys, "t").agg(F.max_by("value", "real").alias("x"), F.max("real").alias("real"))
    if plan.imputer != "labels":
        rest = registry.get("imputer", plan.imputer)(came.drop("real"), blank.select(*keys, "t"), span.select("last"), keys)
    else:
        came = settle(came.filter("real = 1").select(*keys, "t", "x"))
        every = settle(mine.unionByName(E.until_next(blank, keys, span.select("last")).select(*keys, "t", F.lit(0.0).alias("x"))))
        parts = [mine.filter(F.col("t") % clock == 0), came]
        for dim in plan.model.dims:
            stale = others.filter(F.col("dim") == dim)
            parts.append(E.propagate_labels(every.filter((F.col("dim") == dim) & (F.col("t") % clock != 0)), A.hodge(boundaries, dim), stale))
        return settle(union(parts).select("dim", _block("cluster_id", "cell_id").alias("cell_id"), "t", "x"))
    return settle(mine.unionByName(rest.select(*keys, "t", "x")).select("dim", _block("cluster_id", "cell_id").alias("cell_id"), "t", "x"))


def _laplacians(b: dict[int, DataFrame], dim: int) -> tuple[DataFrame | None, DataFrame | None]:
    lower, upper = A.laplacians(b, dim)
    return settle(lower) if lower is not None else None, settle(upper) if upper is not None else None


def ccvar_features(views: list[tuple[dict[int, DataFrame], dict[int, DataFrame]]], model: presets.Model) -> dict[int, DataFrame]:
    """(dim, i, t, f, s) of all enabled dimensions for each key of ``views``, which are boundaries with the signals on them by
    keys. All are made together: round k multiplies what round k - 1 left of all blocks, keys and lags by their sparse
    Laplacians in one join, so no power of a Laplacian, which is dense soon, meets a signal."""
    base, across, signals = [], [], []
    for b, own in views:
        keys = F.explode(F.array(*(F.lit(int(k)).cast("long") for k in own)))
        for k, x in own.items():
            signals.append(x.filter(F.col("dim").isin(list(model.dims))).select(F.lit(int(k)).cast("long").alias("key"), "dim", "cell_id", "t", F.col("x").cast("double").alias("x")))
        for d in model.dims:
            bounds = (d - 1, A.transpose(b[d]) if d in b else None), (d + 1, b.get(d + 1))
            for own_block, block, (of, m), laplacian, most in zip(("sl", "su"), ("l", "u"), bounds, A.laplacians(b, d), model.pair(model.powers, d), strict=True):
                if laplacian is None:
                    continue
                at = F.lit(d).cast("long").alias("dim")
                blocks = [own_block, block] if of in model.dims else [own_block]
                each = laplacian.select(at, F.explode(F.array(*map(F.lit, blocks))).alias("block"), F.lit(most).alias("most"), "i", "j", "val")
                base.append(each.withColumn("key", keys))
                if of in model.dims:
                    across.append(m.select(at, F.lit(block).alias("block"), F.lit(of).cast("long").alias("of"), "i", "j", "val").withColumn("key", keys))
    base, signal = settle(union(base)), union(signals)
    w = Window.partitionBy("key", "dim", "cell_id").orderBy("t")
    lags = {p: f"x{p}" for p in range(1, model.lag + 1)}
    lagged = settle(signal.select("key", "dim", "cell_id", "t", *(F.coalesce(F.lag("x", p).over(w), F.lit(0.0)).alias(n) for p, n in lags.items())))
    total = [F.sum(F.col("val") * F.col(n)).alias(n) for n in lags.values()]
    state = lagged.select("key", "dim", F.explode(F.array(F.lit("sl"), F.lit("su"))).alias("block"), F.col("cell_id").alias("i"), "t", *lags.values())
    if across:
        other = lagged.select("key", F.col("dim").alias("of"), F.col("cell_id").alias("j"), "t", *lags.values())
        state = state.unionByName(union(across).join(other, ["key", "of", "j"]).groupBy("key", "dim", "block", "i", "t").agg(*total))
    powers = []
    for k in range(1, max(k for d in model.dims for k in model.pair(model.powers, d)) + 1):
        right = state.withColumnRenamed("i", "j")
        left = base.filter(F.col("most") >= k).drop("most")
        state = settle(left.join(right, ["key", "dim", "block", "j"]).groupBy("key", "dim", "block", "i", "t").agg(*total))
        powers.append(state.withColumn("k", F.lit(k).cast("long")))
    each = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("lag"), F.col(n).alias("s")) for p, n in lags.items()))).alias("l")
    x = union(powers).select("key", "dim", "i", "t", "block", "k", each).select("key", "dim", "i", "t", "block", "k", "l.lag", "l.s")
    if model.bias:
        zero = F.lit(0).cast("long")
        x = x.unionByName(lagged.select("key", "dim", F.col("cell_id").alias("i"), "t", F.lit("b").alias("block"), zero.alias("k"), zero.alias("lag"), F.lit(1.0).alias("s")))
    if model.normalise:
        x, parts = settle(x), []
        for key, d in ((k, d) for _, own in views for k in own for d in model.dims):
            mine = (F.col("key") == key) & (F.col("dim") == d)
            own = X.normalise(x.filter(mine).drop("key", "dim"), signal.filter(mine).drop("key", "dim"), _agent, model.b)
            parts.append(own.select(F.lit(key).cast("long").alias("key"), F.lit(d).cast("long").alias("dim"), "i", "t", "block", "k", "lag", "s"))
        x = union(parts)
    numbers = [(int(key), d, *c, n) for b, own in views for key in own for d in model.dims for n, c in enumerate(model.columns(d, d in b, d + 1 in b))]
    columns = signal.sparkSession.createDataFrame(numbers, "key long, dim long, block string, k long, lag long, f long")
    x = settle(x.join(F.broadcast(columns), ["key", "dim", "block", "k", "lag"]).select("key", "dim", "i", "t", "f", "s"))  # a row per feature column
    return {key: x.filter(F.col("key") == key).drop("key") for _, own in views for key in own}


def topolms_features(b: dict[int, DataFrame], signal: DataFrame, m: int) -> DataFrame:
    """(dim, i, t, f, s) of the edges, before each step: those after the step before."""
    x = X.topolms(A.lower_laplacian(b[1]), A.upper_laplacian(b[2]), signal.filter("dim = 1").drop("dim"), m)
    return settle(x.select(F.lit(1).cast("long").alias("dim"), "i", (F.col("t") + 1).alias("t"), "f", F.col("s").cast("double").alias("s")))


def _alone(view: DataFrame) -> DataFrame:
    return view.select(F.col("cluster_id").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))


def _case(plan: Plan, boundaries: dict[int, DataFrame], signal: DataFrame, view: DataFrame, owned: DataFrame, targets: DataFrame, weights: DataFrame, heard: DataFrame | None = None, copies: DataFrame | None = None, made: dict | None = None, bare: bool = False) -> Case:
    """``made``: what cases on one view share, their boundaries and targets, is kept here. ``bare``: without features."""
    made = {} if made is None else made
    if "boundaries" not in made:
        made["boundaries"] = agent_boundaries(boundaries, view)
    b = made["boundaries"]
    own, model = held(signal, view, owned, plan, boundaries, heard, copies), plan.model
    if model.kind == "topolms":
        widths = {1: 2 * model.m + 1}
    else:
        widths = {d: len(model.columns(d, d in b, d + 1 in b)) for d in model.dims}
    if ("targets", *widths) not in made:
        made["targets", *widths] = settle(targets.filter(F.col("dim").isin(list(widths))).select("dim", _block("cluster_id", "cell_id").alias("i")))
    case = Case(plan, b, own, None, made["targets", *widths], weights, widths)
    return case if bare else ready({0: case})[0]


def ready(cases: dict[int, Case]) -> dict[int, Case]:
    """The cases with their features; those of one CC-VAR model are made together, whatever their views."""
    out, alike = dict(cases), {}
    for key, c in cases.items():
        if c.features is None and c.plan.model.kind == "topolms":
            out[key] = replace(c, features=topolms_features(c.boundaries, c.signal, c.plan.model.m))
        elif c.features is None:
            alike.setdefault(c.plan.model, {}).setdefault(id(c.boundaries), {})[key] = c
    for model, views in alike.items():
        features = ccvar_features([(next(iter(own.values())).boundaries, {k: c.signal for k, c in own.items()}) for own in views.values()], model)
        out |= {k: replace(cases[k], features=x) for k, x in features.items()}
    return out


class Setting:
    """What cases on one clustering share, settled once."""

    def __init__(self, f: Fixture, clustering: presets.Clustering | None = None, observed: DataFrame | None = None, like: Setting | None = None) -> None:
        """``observed``: (cluster_id, dim, cell_id, t, x), what each cluster itself sees of the cells that it shares, where that
        isn't the signal. ``like``: a setting of the same clusters, "given" ones, that differs in ``q_hop`` alone; what doesn't
        depend on it is taken over."""
        c = clustering or presets.Clustering()
        if like is not None:
            if replace(c, q_hop=1) != replace(like.clustering, q_hop=1) or c.kind != "given":
                raise ValueError("only settings of the same given clusters share their tables")
            self.__dict__ |= like.__dict__ | {"clustering": c, "observed": observed}
            p = P.partition(self.boundaries, f.community(), c.dim, c.q_hop, like=like.partition)
            self._seen(p)
            return
        self.f, self.signal, self.boundaries = f, scaled(f), {k: settle(b) for k, b in f.boundaries().items()}
        if c.kind == "hops":
            p = P.hop_partition(self.boundaries, c.d, c.dim, c.q_hop)
        else:
            community = f.community()
            if c.kind == "modularity":
                graph = settle(A.off_diagonal(A.lower_laplacian(self.boundaries[c.dim])).select("i", "j"))
                community = settle(P.greedy_modularity(graph, c.best_n, c.resolution))
            p = P.partition(self.boundaries, community, c.dim, c.q_hop) if c.kind != "given" or c.q_hop > 1 else f.partition()
        self.clustering, self.partition = c, p
        self.owned, self.interface, self.observed = settle(p.owned), p.interface, observed
        self.weights = settle(G.metropolis_weights(p.agent_graph, self.owned))
        self.everything = settle(G.global_agent(f.cells()))
        self._seen(p)

    def _seen(self, p: P.Partition) -> None:
        """What depends on what the clusters import."""
        self.index = settle(p.local_index)
        self.heard = settle(E.senders(p.needs, P.both_ways(p.interface)))
        self.out = settle(G.partial_indices(self.index, self.owned).filter("is_out").select("cluster_id", "dim", "cell_id"))
        self.made = {"whole": {}, "inside": {}, "index": {}}

    def whole(self, plan: Plan = PRESETS["global"], bare: bool = False) -> Case:
        return replace(_case(plan, self.boundaries, self.signal, self.everything, self.everything, self.everything, _alone(self.everything), made=self.made["whole"], bare=bare), whole=True)

    def agents(self, plan: Plan, bare: bool = False) -> Case:
        """The agents of the clustering; ``plan.inside``: each on what it predicts, nothing imported. ``bare``: without features,
        to be made ``ready`` with other cases."""
        view = self.out if plan.inside else self.index
        mixing = _alone(self.owned) if plan.rule.mixing == "none" else self.weights
        copies = None
        if plan.interface == "averaged":
            copies = settle(E.interface_copies(P.both_ways(self.interface), self.observed if self.observed is not None else self.signal))
        heard = self.heard if plan.data_sends or copies is not None else None
        return _case(plan, self.boundaries, self.signal, view, self.out if plan.inside else self.owned, self.out, mixing, heard, copies, self.made["inside" if plan.inside else "index"], bare)


def learn(cases: dict[int, Case], truth: DataFrame) -> DataFrame:
    """(THETA) histories of the cases, in one go."""
    return L.history(folded(cases, truth, ends=False))


def folded(cases: dict[int, Case], truth: DataFrame, initial: DataFrame | None = None, since: int | None = None, before: int | None = None, ends: bool = True) -> DataFrame:
    """(learning.FOLDED) of the cases; cases of one number of features per dimension each. Matrices of cases that have the same
    features and targets are made once. ``initial``: states to start from
    (``learning.final_state`` of an earlier fold); ``since``, ``before``: only steps from one on, or before another."""
    grams, plains, owns, mixes, came, widths, first, same = [], [], [], [], [], {}, {}, {}
    truth = truth.filter(F.lit(True) if since is None else F.col("t") >= since).filter(F.lit(True) if before is None else F.col("t") < before)
    keys = ["case_id", "dim", "agent", "t"]
    for case, c in cases.items():
        if any(widths.get(d, w) != w for d, w in c.widths.items()):
            raise ValueError("cases that are learned together need features of one layout")
        widths |= c.widths
        mixes.append(c.weights.select(F.lit(case).cast("long").alias("case_id"), "src", "dst", "w"))
        if c.plan.rule.sends and c.plan.rule.mixing != "none":
            got = E.receipts(c.weights, truth.select("t").distinct(), F.expr(c.plan.rule.sends))
            came.append(got.select(F.lit(case).cast("long").alias("case_id"), "t", "src", "dst"))
        made = (id(c.features), id(c.targets), c.plan.model)
        same[case] = first.setdefault(made, case) if initial is None else case
        if same[case] != case:
            continue
        own = c.features.filter(F.lit(True) if since is None else F.col("t") >= since).filter(F.lit(True) if before is None else F.col("t") < before)
        own = own.join(c.targets, ["dim", "i"], "left_semi").withColumn("agent", _agent("i")).withColumn("case_id", F.lit(case).cast("long"))
        plain = [d for d in c.widths if not any(c.plan.model.pair(c.plan.model.mu, d)) or c.plan.model.kind != "ccvar"]
        if plain:
            plains.append(own.filter(F.col("dim").isin(plain)))
        for d in set(c.widths) - set(plain):
            cells = c.targets.filter(F.col("dim") == d).select("i")
            weight = A.smoothing(cells, *(A.submatrix(m, cells, cells) if m is not None else None for m in A.laplacians(c.boundaries, d)), *map(float, c.plan.model.pair(c.plan.model.mu, d)))
            grams.append(A.gram(own.filter(F.col("dim") == d), keys, weight=settle(weight)))
        owns.append(own)
    if plains:  # matrices and sides of all cases by one join each
        grams.append(A.gram(union(plains), keys))
    y = truth.select("dim", F.col("cell_id").alias("cell"), "t", F.col("x").alias("y"))
    targets = union(owns).withColumn("cell", F.col("i") % BLOCK).join(y, ["dim", "cell", "t"])
    sides = targets.groupBy(*keys, "f").agg(F.sum(F.col("s") * F.col("y")).alias("val"))
    rules = {k: c.plan.rule for k, c in cases.items()}
    return settle(L.folded(union(grams), sides, union(mixes), rules, widths, receipts=union(came) if came else None, initial=initial, ends=ends, same=same))


def operator(c: Case) -> tuple[DataFrame, dict[int, int]]:
    """The entries by which cells enter features (dim, i, of, j, base, val), and the numbers of constant features."""
    out, biases, model = [], {}, c.plan.model
    for d in c.widths:
        columns = model.columns(d, d in c.boundaries, d + 1 in c.boundaries)
        at = {}
        for n, (block, k, _) in enumerate(columns):
            at.setdefault((block, k), n)
        if model.bias:
            biases[d] = at["b", 0]
        lower, upper = _laplacians(c.boundaries, d)
        low, up = model.pair(model.powers, d)
        stacks = {"sl": (d, A.powers(lower, low))} if lower is not None else {}
        stacks |= {"su": (d, A.powers(upper, up))} if upper is not None else {}
        if ("l", 1) in at:
            stacks["l"] = (d - 1, A.each_times(stacks["sl"][1], A.transpose(c.boundaries[d])))
        if ("u", 1) in at:
            stacks["u"] = (d + 1, A.each_times(stacks["su"][1], c.boundaries[d + 1]))
        for block, (of, stack) in stacks.items():
            base = (F.lit(at[block, 1]) + (F.col("k") - 1) * model.lag).cast("long")
            out.append(stack.select(F.lit(d).cast("long").alias("dim"), "i", F.lit(of).cast("long").alias("of"), "j", base.alias("base"), "val"))
    return union(out), biases


def rolled(c: Case, theta: DataFrame, horizon: int) -> DataFrame:
    """(dim, i, t_made, horizon, yhat): forecasts up to ``horizon`` steps ahead of every cell that an agent sees, made
    after each step; predictions are fed back into the lag buffers of all dimensions."""
    entries, biases = operator(c)
    buffer = union(X.lags(c.signal.filter(F.col("dim") == d), c.plan.model.lag - 1, 0).select(F.lit(d).cast("long").alias("dim"), F.col("cell_id").alias("i"), "t", (F.col("lag") + 1).alias("lag"), "x") for d in c.widths)
    cells = c.signal.select("dim", F.col("cell_id").alias("i"), "t").withColumn("agent", _agent("i"))
    own = cells.join(theta.drop("case_id"), ["dim", "agent", "t"]).select("dim", "i", "t", F.col("idx").alias("f"), "value")
    return L.rollout(entries, settle(buffer), own, biases, c.plan.model.lag, horizon)


def forecasts(cases: dict[int, Case], theta: DataFrame, everything: bool = False) -> DataFrame:
    """Forecasts at each case's horizon as (case_id, cluster_id, dim, cell_id, i, yhat), i the step that is forecast, of
    predicted cells or of all that agents see."""
    parts, features, same, first = [], [], {}, {}
    for case, c in cases.items():
        h, number = c.plan.model.horizon, F.lit(case).cast("long").alias("case_id")
        if h == 1:  # cases that have the same features are predicted by one join, as are all others
            same[case] = first.setdefault((id(c.features), id(c.targets)), case)
            if same[case] == case:
                x = c.features if everything else c.features.join(c.targets, ["dim", "i"], "left_semi")
                features.append(x.select(number, "dim", _agent("i").alias("agent"), F.col("i").alias("cell_id"), "t", "f", "s"))
        else:
            x = rolled(c, theta.filter(F.col("case_id") == case), h).filter(F.col("horizon") == h).select(number, "dim", "i", (F.col("t_made") + h).alias("t"), "yhat")
            parts.append(x if everything else x.join(c.targets, ["dim", "i"], "left_semi"))
    if features:
        x = L.predict(union(features), theta.filter(F.col("case_id").isin(list(same))), same)
        parts.append(x.select("case_id", "dim", F.col("cell_id").alias("i"), "t", "yhat"))
    return union(parts).select("case_id", _agent("i").alias("cluster_id"), "dim", (F.col("i") % BLOCK).alias("cell_id"), F.col("t").alias("i"), "yhat")


def truth(signal: DataFrame) -> DataFrame:
    return signal.select("dim", "cell_id", F.col("t").alias("i"), F.col("x").alias("y"))


def scored(signal: DataFrame, cases: dict[int, Case], theta: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Errors of the cases. ``onto``: ownership of clusters, onto whose cells the cases of a single agent are projected, so
    that all cases are compared on the same cells."""
    made = forecasts(cases, theta)
    if onto is not None:
        alone = [k for k, c in cases.items() if c.whole]
        whole = made.filter(F.col("case_id").isin(alone)).drop("cluster_id")
        made = made.filter(~F.col("case_id").isin(alone)).unionByName(G.project(whole, onto))
    more = sorted({m for c in cases.values() for m in c.plan.metrics})
    x = M.with_truth(M.aggregate(made), truth(signal))
    return M.tv_metrics(settle(x) if more else x, {m: registry.get("metric", m) for m in more})


def flat(theta: DataFrame, widths: dict[int, int]) -> DataFrame:
    """Parameters of all dimensions as one vector per agent: (case_id, agent, t, idx, value)."""
    first, at = {}, 0
    for d in sorted(widths):
        first[d], at = at, at + widths[d]
    start = F.element_at(F.create_map(*(F.lit(x) for kv in first.items() for x in kv)), F.col("dim").cast("int"))
    return theta.select("case_id", "agent", "t", (F.col("idx") + start).cast("long").alias("idx"), "value")


def run(f: Fixture, plan: Plan, setting: Setting | None = None, case: int = 0, whole: bool = False) -> DataFrame:
    """One case of a plan from clustering to errors, with the plan's parameters as columns."""
    s = setting or Setting(f, plan.clustering)
    cases = {case: s.whole(plan) if whole else s.agents(plan)}
    return scored(s.signal, cases, learn(cases, s.signal)).withColumns({k: F.lit(v) for k, v in plan.columns().items()})


PLAN = PRESETS["default"]


@query("global_case")
def global_case(f: Fixture) -> DataFrame:
    s = Setting(f)
    cases = {0: s.whole()}
    return scored(s.signal, cases, learn(cases, s.signal))


@query("pure_local_case")
def pure_local_case(f: Fixture) -> DataFrame:
    s = Setting(f)
    cases = {1: s.agents(PRESETS["local"])}
    return scored(s.signal, cases, learn(cases, s.signal))


@query("distributed_case")
def distributed_case(f: Fixture) -> DataFrame:
    s = Setting(f)
    cases = {2: s.agents(PLAN)}
    return scored(s.signal, cases, learn(cases, s.signal))


@query("planned_case")
def planned_case(f: Fixture) -> DataFrame:
    """Everything that a plan can set away from its default: smoothing, normalisation, zero padding, two steps ahead, K-GT."""
    plan = merged(PLAN, model={"mu": (0.1, (0.1, 0.2), 0.1), "normalise": True, "horizon": 2, "powers": (1, (2, 1), 1)}, rule={"mixing": "kgt", "clock": 5, "c": 0.5}, imputer="zero", data_clock=3)
    return run(f, plan)


@query("ccvar_train")
def ccvar_train(f: Fixture) -> DataFrame:
    s = Setting(f)
    return learn({0: s.whole()}, s.signal)


@query("topolms_train")
def topolms_train(f: Fixture) -> DataFrame:
    s = Setting(f)
    return learn({0: s.whole(merged(PRESETS["global"], model={"kind": "topolms"}, rule={"gamma": 0.0}))}, s.signal)


def tails(s: Setting, cases: dict[int, Case], onto: DataFrame | None = None) -> DataFrame:
    """(metric, case_id, value): means over the last tenth, over the dimensions' means."""
    tv = settle(scored(s.signal, cases, learn(cases, s.signal), onto))
    each = [M.tail_mean(tv, m).groupBy("case_id").agg(F.avg("tail_mean").alias("value")).select(F.lit(m).alias("metric"), F.col("case_id").cast("string").alias("case_id"), "value") for m in ("tv_nmse", "tv_mae", "tv_mape")]
    return union(each)


@query("error_comparison")
def error_comparison(f: Fixture) -> DataFrame:
    """Last-tenth means of the three cases (0 global, 1 local, 2 distributed), as a table of cases by metric; the global
    case is projected onto the clusters' own cells before it is compared."""
    s = Setting(f)
    return M.comparison_table(tails(s, {0: s.whole(), 1: s.agents(PRESETS["local"]), 2: s.agents(PLAN)}, s.owned), ["0", "1", "2"])


def observed(f: Fixture, interface: DataFrame, signal: DataFrame) -> DataFrame:
    """What clusters see of shared cells themselves: off by a tenth of the value per cluster number modulo 3."""
    own = P.both_ways(interface).select(F.col("src").alias("cluster_id"), "dim", "cell_id").distinct()
    return own.join(signal, ["dim", "cell_id"]).select("cluster_id", "dim", "cell_id", "t", (F.col("x") * (1 + F.lit(0.1) * (F.col("cluster_id") % 3))).alias("x"))


@query("averaged_case")
def averaged_case(f: Fixture) -> DataFrame:
    """The distributed case whose agents see shared cells differently and average them with each neighbour at every data
    exchange, each at a clock of its own."""
    s = Setting(f)
    s.observed = observed(f, s.interface, s.signal)
    cases = {6: s.agents(merged(PLAN, interface="averaged", data_sends="t % (3 + agent % 3) = 0"))}
    return scored(s.signal, cases, learn(cases, s.signal))


@query("heuristic_case")
def heuristic_case(f: Fixture) -> DataFrame:
    """The distributed case with a rule of its own for who sends parameters: weights of a step are those of what arrived."""
    s = Setting(f)
    cases = {7: s.agents(merged(PLAN, rule={"mixing": "kgt", "c": 0.5, "sends": "(t + agent) % 4 = 0 or t = 10"})), 8: s.agents(merged(PLAN, rule={"sends": "t % (2 + agent) = 0"}))}
    return scored(s.signal, cases, learn(cases, s.signal))


@query("labels_case")
def labels_case(f: Fixture) -> DataFrame:
    """The distributed case whose agents smooth labels between two data exchanges in place of holding the last values."""
    s = Setting(f)
    cases = {9: s.agents(merged(PLAN, imputer="labels"))}
    return scored(s.signal, cases, learn(cases, s.signal))


@query("resumed_case")
def resumed_case(f: Fixture, at: int = 40) -> DataFrame:
    """The distributed case folded in two parts: the second starts from the state that the first left."""
    s = Setting(f)
    cases = {2: s.agents(PLAN)}
    first = folded(cases, s.signal, before=at)
    second = folded(cases, s.signal, L.final_state(first), since=at, ends=False)
    return scored(s.signal, cases, settle(L.history(first).unionByName(L.history(second))))


@query("dynamic_regret")
def dynamic_regret(f: Fixture) -> DataFrame:
    """Disagreement of the distributed agents, among themselves and with the global parameters of each step."""
    s = Setting(f)
    cases = {0: s.whole(), 2: s.agents(PLAN)}
    theta = settle(flat(learn(cases, s.signal), cases[0].widths))
    x = settle(M.disagreement(theta.filter("case_id = 2"), theta.filter("case_id = 0").select("t", "idx", F.col("value").alias("ref"))))
    names = ("self_disagreement", "self_rms", "global_disagreement", "centroid_to_global", "centroid_to_global_relative", "global_rms", "global_rms_relative")
    for n in names:
        x = x.join(M.rolling(x, n, f"rolling_{n}", ("case_id",), "t"), ["case_id", "t"])
    return x


@query("topolms_regret")
def topolms_regret(f: Fixture) -> DataFrame:
    """The same for Topo-LMS, whose reference is the history of one learner on the whole complex."""
    s = Setting(f)
    plan = merged(PLAN, model={"kind": "topolms"}, rule={"gamma": 0.0, "clock": 1}, data_clock=1)
    cases = {0: s.whole(merged(plan, rule={"mixing": "none"})), 4: s.agents(plan)}
    theta = settle(flat(learn(cases, s.signal), cases[0].widths))
    return M.disagreement(theta.filter("case_id = 4"), theta.filter("case_id = 0").select("t", "idx", F.col("value").alias("ref")))


@query("boundary_error")
def boundary_error(f: Fixture) -> DataFrame:
    """Error on the cells that clusters import from each other, at four data clocks and of the global model (case 0);
    every agent predicts all it sees."""
    s = Setting(f)
    cases = ready({0: s.whole(bare=True)} | {c: s.agents(merged(PLAN, data_clock=c), bare=True) for c in (1, 10, 100, 300)})
    made = forecasts(cases, learn(cases, s.signal), everything=True)
    shared = P.shared(s.index.select("cluster_id", "dim", "cell_id"))
    return M.interface_nmse(M.aggregate(made), truth(s.signal), shared).na.fill({"dim": -1})


@query("comparative")
def comparative(f: Fixture) -> DataFrame:
    """Edge-only agents on one shared snapshot: Topo-LMS with ATC (case 0), CC-VAR with K-GT (case 1)."""
    signal = scaled(f).filter("dim = 1")
    boundaries = {k: settle(b) for k, b in f.boundaries().items()}
    graph = P.only_edges(boundaries)
    weights = settle(G.metropolis_weights(graph["agent_graph"], graph["owned"]))
    plan = PRESETS["comparative"]
    lms = merged(plan, model={"kind": "topolms"}, rule={"gamma": 0.0})
    kgt = merged(plan, rule={"mixing": "kgt", "c": 5e-6})
    own = F.col("i") * F.lit(BLOCK) + F.col("i")
    targets = settle(graph["owned"].select("dim", F.col("cell_id").alias("i")).withColumn("i", own))
    out = []
    for n, p in enumerate((lms, kgt)):
        # features on the whole snapshot; each row goes to its edge's agent
        x = topolms_features(boundaries, signal, p.model.m) if p.model.kind == "topolms" else ccvar_features([(boundaries, {0: signal})], p.model)[0]
        widths = {1: 2 * p.model.m + 1} if p.model.kind == "topolms" else {1: len(p.model.columns(1, True, True))}
        cases = {n: Case(p, boundaries, signal, settle(x.withColumn("i", own)), targets, weights, widths)}
        out.append(scored(signal, cases, learn(cases, signal)))
    return union(out)


@query("six_cases")
def six_cases(f: Fixture) -> DataFrame:
    """Modularity clusters: global, ATC and K-GT, each with CC-VAR on edges (cases 0, 1, 2) and Topo-LMS (3, 4, 5)."""
    s = Setting(f, presets.Clustering("modularity"))
    base = merged(PLAN, data_clock=1, rule={"clock": 1}, model={"dims": (1,)})
    lms = merged(base, model={"kind": "topolms"}, rule={"gamma": 0.0})
    none, kgt = {"mixing": "none"}, {"mixing": "kgt", "c": 5e-6}
    wide, small = ({k: s.whole(merged(p, rule=none)) if not k % 3 else s.agents(merged(p, rule=kgt if k % 3 == 2 else {})) for k in ks} for p, ks in ((base, (0, 1, 2)), (lms, (3, 4, 5))))
    return union(scored(s.signal, cases, learn(cases, s.signal)) for cases in (wide, small))


@query("ccvar_forecast_h3")
def ccvar_forecast(f: Fixture, horizon: int = 3) -> DataFrame:
    """Forecasts one to three steps ahead from every step, in all dimensions: predictions are fed back."""
    s = Setting(f)
    case = s.whole()
    return rolled(case, learn({0: case}, s.signal), horizon).select("dim", (F.col("i") % BLOCK).alias("cell_id"), "t_made", "horizon", "yhat")


@query("topolms_forecast_h2")
def topolms_forecast(f: Fixture) -> DataFrame:
    """Topo-LMS two steps ahead from every step: its own predictions are rolled into the regressors."""
    s = Setting(f)
    case = s.whole(merged(PRESETS["global"], model={"kind": "topolms", "m": 1}, rule={"gamma": 0.0}))
    theta = learn({0: case}, s.signal)
    lower, upper = settle(A.lower_laplacian(case.boundaries[1])), settle(A.upper_laplacian(case.boundaries[2]))
    return L.topolms_rollout(lower, upper, case.features.withColumn("t", F.col("t") - 1), theta.select("t", F.col("idx").alias("f"), "value"), 1, 2).withColumn("cell_id", F.col("i") % BLOCK).select("cell_id", "t_made", "horizon", "yhat")


CLOCKS = (1, 2, 5, 10)
#: Powers of the Laplacians in the sweep.
WIDE = {"powers": (5, (5, 5), 5)}


def swept_cases(s: Setting, grid: list[tuple[int, int]], model: dict = WIDE) -> dict[int, Case]:
    """The distributed case at each pair (data clock d, parameter clock p), by 100 d + p."""
    plans = {(d, p): merged(PLAN, data_clock=d, rule={"clock": p}, model=model) for d, p in grid}
    made = ready({d: s.agents(plan, bare=True) for d, plan in {d: plan for (d, _), plan in plans.items()}.items()})  # features depend on the data clock alone
    return {100 * d + p: replace(made[d], plan=plan) for (d, p), plan in plans.items()}


def swept(s: Setting, cases: dict[int, Case], theta: DataFrame) -> DataFrame:
    """(data_clock, param_clock, value): last-tenth NMSE of ``swept_cases``, over the dimensions' means."""
    x = last_tenth(s, cases, theta)
    return x.select(F.floor(F.col("case_id") / 100).alias("data_clock"), (F.col("case_id") % 100).alias("param_clock"), F.col("tv_nmse").alias("value"))


def last_tenth(s: Setting, cases: dict[int, Case], theta: DataFrame) -> DataFrame:
    """(case_id, tv_nmse): means over the last tenth, over the dimensions' means."""
    return settle(M.tail_mean(scored(s.signal, cases, theta), "tv_nmse").groupBy("case_id").agg(F.avg("tail_mean").alias("tv_nmse")))


def pairs() -> list[tuple[int, int]]:
    return [(d, p) for d in CLOCKS for p in CLOCKS]


@query("sweep")
def sweep(f: Fixture) -> DataFrame:
    """Stage 1: data and parameter clocks 1, 2, 5 and 10 on the distributed case: last-tenth NMSE, a column per data clock."""
    s = Setting(f)
    cases = swept_cases(s, pairs())
    x = swept(s, cases, learn(cases, s.signal))
    return x.groupBy("param_clock").pivot("data_clock", list(CLOCKS)).agg(F.first("value"))


@query("sweep_hops")
def sweep_hops(f: Fixture) -> DataFrame:
    """Stage 2: the best pair of stage 1 by the rule (the smallest NMSE, of equals the rarest exchange), at Q = 1 to 4 hops, and
    how far its agents disagree at the end."""
    s = Setting(f)
    cases = swept_cases(s, pairs())
    theta = learn(cases, s.signal)
    first = swept(s, cases, theta)
    best = first.orderBy(F.round("value", 9), F.col("data_clock").desc(), F.col("param_clock").desc()).first()
    at = 100 * int(best["data_clock"]) + int(best["param_clock"])
    plan = cases[at].plan
    # stage 1 is the one at one hop; the others are made, learned and compared together
    more = ready({q: Setting(f, presets.Clustering(q_hop=q), like=s).agents(plan, bare=True) for q in (2, 3, 4)})
    ahead = learn(more, s.signal)
    one = first.filter((F.col("data_clock") == plan.data_clock) & (F.col("param_clock") == plan.rule.clock)).select(F.lit(1).cast("long").alias("case_id"), F.col("value").alias("tv_nmse"))
    tv = one.unionByName(last_tenth(s, more, ahead))
    both = theta.filter(F.col("case_id") == at).withColumn("case_id", F.lit(1).cast("long")).unionByName(ahead)
    apart = M.tail_mean(settle(M.disagreement(flat(both, cases[at].widths))), "self_disagreement", ("case_id",), "t").withColumnRenamed("tail_mean", "self_disagreement")
    x = tv.join(apart, "case_id")
    return x.select(F.col("case_id").alias("q_hop"), F.lit(plan.data_clock).cast("long").alias("data_clock"), F.lit(plan.rule.clock).cast("long").alias("param_clock"), "tv_nmse", "self_disagreement")
