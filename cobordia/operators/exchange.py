"""Message exchange between agents: clocks, messages, imputation of what is missing or stale.

None of it depends on parameters, so a whole timeline is exchanged and imputed at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobordia.session import counted, settle

CELL = ["dim", "cell_id"]


def fires(clock: int, t: str = "t", rule: Column | None = None) -> Column:
    """Does the step send: every ``clock`` steps, the first one included, or by a rule of one's own."""
    return rule if rule is not None else F.col(t) % clock == 0


def gate(times: DataFrame, clock: int, rule: Column | None = None) -> DataFrame:
    return times.filter(fires(clock, rule=rule))


def receipts(weights: DataFrame, times: DataFrame, sends: Column) -> DataFrame:
    """(t, src, dst): at step t the parameters of ``dst`` arrive at ``src``, for each pair of ``weights``. ``sends``: a
    condition on (t, agent), does the agent send at that step. A sender's own pair is there whether or not it has
    neighbours. The steps of ``times`` meet each agent once, never each pair."""
    agents = weights.select(F.col("dst").alias("agent")).distinct()
    sent = agents.join(counted(times.select("t")), how="cross").filter(sends).select("t", F.col("agent").alias("dst"))  # a timeline
    pairs = weights.filter("src <> dst").select("src", "dst").unionByName(agents.select(F.col("agent").alias("src"), F.col("agent").alias("dst")))
    return sent.join(pairs, "dst").select("t", "src", "dst")


def latest(outbox: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """What a flush takes: the last payload written for each key."""
    return outbox.groupBy(*keys).agg(F.max_by(payload, "t").alias(payload), F.max("t").alias("t"))


def messages(needs: DataFrame, interface: DataFrame, signal: DataFrame, clock: int) -> DataFrame:
    """(t, src, dst, kind, dim, cell_id, value): at each step that sends, the owned cells a neighbour asked for and
    the sender's copy of their interface. ``needs``: ``src`` asks ``dst``; ``interface``: (src, dst, …) both ways."""
    own = needs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("owned").alias("kind"), *CELL)
    both = own.unionByName(interface.select("src", "dst", F.lit("interface").alias("kind"), *CELL))
    sent = signal.filter(fires(clock)).select(*CELL, "t", F.col("x").alias("value"))
    return both.join(sent, CELL).select("t", "src", "dst", "kind", *CELL, "value")


def until_next(arrived: DataFrame, keys: list[str], last: DataFrame) -> DataFrame:
    """Each of ``arrived`` (keys, t, ...) at every step from its own to the one before the key's next, as-of. ``last``: one
    row (last), the last step there is. Rows are sorted by key once; no key meets a timeline."""
    nxt = F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))
    x = arrived.withColumn("nxt", nxt).join(F.broadcast(last), how="cross")  # one row
    x = x.withColumn("upto", F.coalesce(F.col("nxt") - 1, F.col("last"))).filter("upto >= t")
    return x.withColumn("t", F.explode(F.sequence("t", "upto"))).drop("nxt", "upto", "last")


def held_between(came: DataFrame, blank: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, x) at every step: the last value that came."""
    return until_next(came.select(*keys, "t", "x"), keys, last)


def zero_between(came: DataFrame, blank: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, x) at every step: what came at that very step, else 0."""
    every = until_next(blank.select(*keys, "t"), keys, last)
    return every.join(came, [*keys, "t"], "left").select(*keys, "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def fresh(inbox: DataFrame, now: DataFrame, accept_stale: bool = False) -> DataFrame:
    """Messages as of each step of ``now`` (t): of the same step, or with ``accept_stale`` the last up to it."""
    if not accept_stale:
        return inbox.join(now, "t")
    last = now.agg(F.max("t").alias("last"))
    return until_next(inbox, ["src", "dst", "kind", *CELL], last).join(now, "t", "left_semi")


def impute_zero(wanted: DataFrame, received: DataFrame) -> DataFrame:
    """Wanted (src, dst, dim, cell_id, t) with what came at that very step, else 0."""
    own = received.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *CELL, "t", "value")
    return wanted.join(own, ["src", "dst", *CELL, "t"], "left").na.fill({"value": 0})


def impute_hold(wanted: DataFrame, received: DataFrame) -> DataFrame:
    """Wanted cells with the last value that came up to that step, 0 before any did: messages and wanted steps in one
    sorted stream, the messages of a step first."""
    keys = ["src", "dst", *CELL]
    own = received.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *CELL, "t", "value", F.lit(0).alias("asks"))
    asked = wanted.select(*keys, "t", F.lit(None).cast(dict(own.dtypes)["value"]).alias("value"), F.lit(1).alias("asks"))
    w = Window.partitionBy(*keys).orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = own.unionByName(asked).withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(0)))
    return x.filter("asks = 1").select(*keys, "t", "value")


def senders(needs: DataFrame, interface: DataFrame) -> DataFrame:
    """(cluster_id, src, kind, dim, cell_id): whom a cluster hears of each cell from: imports from their owners, interface
    cells from each neighbour that shares them. ``needs``: ``src`` asks ``dst``; ``interface``: (src, dst, ...) both ways."""
    own = needs.select(F.col("src").alias("cluster_id"), F.col("dst").alias("src"), F.lit("owned").alias("kind"), *CELL)
    return own.unionByName(interface.select(F.col("src").alias("cluster_id"), F.col("dst").alias("src"), F.lit("interface").alias("kind"), *CELL))


def interface_copies(interface: DataFrame, seen: DataFrame) -> DataFrame:
    """(src, dst, dim, cell_id, t, x): what each cluster itself sees of the cells it shares with each neighbour, step by
    step. ``seen``: a signal (dim, cell_id, t, x) that all see alike, or with a ``cluster_id`` what each of them sees."""
    if "cluster_id" not in seen.columns:
        return interface.join(seen, CELL).select("src", "dst", *CELL, "t", "x")
    return interface.join(seen.withColumnRenamed("cluster_id", "src"), ["src", *CELL]).select("src", "dst", *CELL, "t", "x")


def exchanged(heard: DataFrame, signal: DataFrame, sends: Column, copies: DataFrame | None = None) -> DataFrame:
    """(cluster_id, dim, cell_id, t, value): what clusters have of others' cells right after each exchange.

    ``heard``: as from ``senders``; ``sends``: a condition on (t, agent). Imports are the sender's value. Interface cells are
    too, or with ``copies`` the mean of one's own copy for that neighbour and the neighbour's for oneself. Of several
    senders at one step the largest id counts.
    """
    sent = lambda d: d.withColumn("agent", F.col("src")).filter(sends).drop("agent")
    parts = [sent(heard.filter("kind = 'owned'" if copies is not None else "true").join(signal, CELL)).select("cluster_id", "src", *CELL, "t", F.col("x").cast("double").alias("value"))]
    if copies is not None:
        own = copies.select(F.col("src").alias("cluster_id"), F.col("dst").alias("src"), *CELL, "t", F.col("x").alias("own"))
        theirs = sent(copies.select("src", F.col("dst").alias("cluster_id"), *CELL, "t", "x"))
        both = theirs.join(own, ["cluster_id", "src", *CELL, "t"])
        parts.append(both.select("cluster_id", "src", *CELL, "t", (0.5 * (F.col("own") + F.col("x"))).alias("value")))
    x = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return x.groupBy("cluster_id", *CELL, "t").agg(F.max_by("value", "src").alias("value"))


def take_owned(local: DataFrame, received: DataFrame) -> DataFrame:
    """Local cells (cluster_id, dim, cell_id, t, x) overwritten by what their owners sent."""
    got = received.filter("kind = 'owned'").groupBy(F.col("dst").alias("cluster_id"), *CELL, "t").agg(F.max_by("value", "src").alias("value"))
    x = local.join(got, ["cluster_id", *CELL, "t"], "left")
    return x.select("cluster_id", *CELL, "t", F.coalesce("value", "x").alias("x"))


def average_interface(copies: DataFrame, received: DataFrame) -> DataFrame:
    """Own copies (cluster_id, dim, cell_id, t, x) of interface cells, each the mean of itself and the incoming one; of
    several neighbours the largest id counts."""
    got = received.filter("kind = 'interface'").groupBy(F.col("dst").alias("cluster_id"), *CELL, "t").agg(F.max_by("value", "src").alias("value"))
    x = copies.join(got, ["cluster_id", *CELL, "t"], "left")
    return x.select("cluster_id", *CELL, "t", F.when(F.col("value").isNull(), F.col("x") * 1.0).otherwise(0.5 * (F.col("value") + F.col("x"))).alias("x"))


def split_local(local: DataFrame, needs: DataFrame, interface: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own view with imported and interface rows at 0, interface copies as they were before that)."""
    masked = needs.select(F.col("src").alias("cluster_id"), *CELL).unionByName(interface.select(F.col("src").alias("cluster_id"), *CELL)).distinct()
    hidden = local.join(masked.withColumn("hidden", F.lit(True)), ["cluster_id", *CELL], "left")
    view = hidden.select("cluster_id", *CELL, "t", F.when(F.col("hidden"), 0).otherwise(F.col("x")).alias("x"))
    copies = local.join(interface.select(F.col("src").alias("cluster_id"), *CELL).distinct(), ["cluster_id", *CELL], "left_semi")
    return view, copies


def _by_inverse(known: DataFrame, matrix: DataFrame) -> DataFrame:
    """(cluster_id, dim, cell_id, t, smooth): a dense pseudo-inverse per (cluster_id, dim) times the values ``known``."""

    def solve(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if values.empty:
            return pd.DataFrame({"cluster_id": [], "dim": [], "cell_id": [], "t": [], "smooth": []})
        cells, place = np.unique(values.cell_id, return_inverse=True)
        times, at = np.unique(values.t, return_inverse=True)
        m, x = np.zeros((len(cells), len(cells))), np.zeros((len(cells), len(times)))
        m[np.searchsorted(cells, entries.i), np.searchsorted(cells, entries.j)] = entries.val
        x[place, at] = values.x
        return values.assign(smooth=(np.linalg.pinv(m) @ x)[place, at])[["cluster_id", "dim", "cell_id", "t", "smooth"]]

    entries = matrix.select(F.col("cluster_id").alias("of_cluster"), F.col("dim").alias("of_dim"), "i", "j", "val")
    groups = known.groupBy("cluster_id", "dim").cogroup(entries.groupBy("of_cluster", "of_dim"))
    return groups.applyInPandas(lambda a, b: solve(a, b), "cluster_id long, dim long, cell_id long, t long, smooth double")


def _by_gradients(known: DataFrame, matrix: DataFrame, tolerance: float, most: int) -> DataFrame:
    """As ``_by_inverse``, by conjugate gradients on the normal equations of all systems (cluster_id, dim, t) at once.

    They start from 0 and so end at the solution of least squares that has the smallest norm, which is the pseudo-inverse's,
    also where the matrix is singular or indefinite. A system rests when its residual, times the matrix, is ``tolerance``
    of what it was. A round is two products with the sparse matrix, each a join and a sum, and its scalars are sums per
    system that are joined back; whether any system still moves is all that comes to the driver.
    """
    system = ["cluster_id", "dim", "t"]
    cell = [*system, "cell_id"]

    def times(of: DataFrame, column: str) -> DataFrame:
        given = of.filter(F.col(column) != 0).select(*system, F.col("cell_id").alias("j"), F.col(column).alias("y"))
        summed = matrix.join(given, ["cluster_id", "dim", "j"]).groupBy(*system, F.col("i").alias("cell_id")).agg(F.sum(F.col("val") * F.col("y")).alias("product"))
        return of.join(summed, cell, "left").na.fill(0.0, ["product"])

    def squares(of: DataFrame, column: str, name: str) -> DataFrame:
        return of.groupBy(*system).agg(F.sum(F.col(column) * F.col(column)).alias(name))

    start = settle(times(known.select(*cell, F.col("x").alias("r")), "r"))
    state = start.join(squares(start, "product", "gamma"), system)
    state = state.select(*cell, F.lit(0.0).alias("x"), "r", F.col("product").alias("p"), "gamma", (F.lit(tolerance**2) * F.col("gamma")).alias("aim"))
    for _ in range(most):
        went = settle(times(state, "p"))
        moved = went.join(squares(went, "product", "length"), system).withColumn("step", F.when(F.col("length") > 0, F.col("gamma") / F.col("length")).otherwise(0.0))
        moved = moved.select(*cell, (F.col("x") + F.col("step") * F.col("p")).alias("x"), (F.col("r") - F.col("step") * F.col("product")).alias("r"), "p", "gamma", "aim")
        turned = settle(times(moved, "r"))
        rests = F.col("after") <= F.col("aim")  # what rests keeps x and takes no part in products
        after = squares(turned, "product", "after")
        state = turned.join(after, system).select(
            *cell, "x", F.when(rests, 0.0).otherwise(F.col("r")).alias("r"), F.when(rests, 0.0).otherwise(F.col("product") + F.col("after") / F.col("gamma") * F.col("p")).alias("p"), F.when(rests, 0.0).otherwise(F.col("after")).alias("gamma"), "aim"
        )
        if not state.filter("gamma > 0").limit(1).count():
            return state.select("cluster_id", *CELL, "t", F.col("x").alias("smooth"))
    raise ValueError(f"smoothing did not come to rest within {most} rounds")


def propagate_labels(local: DataFrame, laplacian: DataFrame, stale: DataFrame, strength: float = 0.01, dense: int = 1 << 20, tolerance: float = 1e-12, most: int = 1000) -> DataFrame:
    """Tikhonov smoothing of stale cells: per (cluster_id, t) the values f with (I + strength · diag… L) f = fresh
    values, by the pseudo-inverse of the Laplacian whose diagonal is strength · diag + 1; fresh cells stay.

    ``local``: (cluster_id, dim, cell_id, t, x), dimensions of one complex that ``laplacian`` (i, j, val) is of; ``stale``:
    (cluster_id, dim, cell_id). Views of which neither the cells squared nor the values exceed ``dense`` are solved by an
    inverse in a task each, all others together by conjugate gradients in joins, so that no view has to fit a task.
    Where nothing is stale nothing is solved.
    """
    marked = settle(local.join(stale.select("cluster_id", *CELL).distinct().withColumn("stale", F.lit(True)), ["cluster_id", *CELL], "left").na.fill({"stale": False}))
    views = marked.groupBy("cluster_id", *CELL).agg(F.count("*").alias("rows"), F.max("stale").alias("stale"))
    views = views.groupBy("cluster_id", "dim").agg(F.count("*").alias("cells"), F.sum("rows").alias("rows"), F.max("stale").alias("stale")).filter("stale")
    views = settle(views.select("cluster_id", "dim", ((F.col("cells") * F.col("cells") <= dense) & (F.col("rows") <= dense)).alias("small")))
    known = marked.join(views, ["cluster_id", "dim"]).select("cluster_id", *CELL, "t", "small", F.when(F.col("stale"), 0.0).otherwise(F.col("x").cast("double")).alias("x"))

    inside = marked.join(views, ["cluster_id", "dim"]).select("cluster_id", *CELL, "small").distinct()
    diagonal = laplacian.filter("i = j").groupBy(F.col("i").alias("cell_id")).agg(F.sum("val").alias("val"))
    own = inside.join(diagonal, "cell_id", "left").select("cluster_id", "dim", "small", F.col("cell_id").alias("i"), F.col("cell_id").alias("j"), (strength * F.coalesce(F.col("val").cast("double"), F.lit(0.0)) + 1).alias("val"))
    across = inside.withColumnRenamed("cell_id", "i").join(laplacian.filter("i <> j"), "i").join(inside.select("cluster_id", "dim", F.col("cell_id").alias("j")), ["cluster_id", "dim", "j"])
    matrix = settle(own.unionByName(across.select("cluster_id", "dim", "small", "i", "j", F.col("val").cast("double").alias("val"))))

    parts = []
    if views.filter("small").limit(1).count():
        parts.append(_by_inverse(known.filter("small"), matrix.filter("small")))
    if views.filter("not small").limit(1).count():
        parts.append(_by_gradients(known.filter("not small"), matrix.filter("not small"), tolerance, most))
    if not parts:
        return marked.select("cluster_id", *CELL, "t", F.col("x").cast("double").alias("x"))
    smooth = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = marked.join(smooth, ["cluster_id", *CELL, "t"], "left")
    return out.select("cluster_id", *CELL, "t", F.when(F.col("stale"), F.col("smooth")).otherwise(F.col("x").cast("double")).alias("x"))
