"""Lagged topological features: closed forms over a whole timeline, ready for the sequential learners.

Signals are (cell_id, t, x) with every step present for every cell. Operators meet the lagged signal in an equi-join on
the cell, with a sum grouped by (cell, step, feature).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobordia.operators import incidence as A
from cobordia.session import counted


def centre(signal: DataFrame) -> DataFrame:
    """Each dimension less one mean over all its cells and steps. It looks ahead, so it is for batch only."""
    means = signal.groupBy("dim").agg(F.avg("x").alias("mean"))  # a row per dimension
    return signal.join(F.broadcast(means), "dim").select(*(c for c in signal.columns if c != "x"), (F.col("x") - F.col("mean")).alias("x"))


def fill(signal: DataFrame, cells: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell at every step of ``times`` (a timeline: counted, then broadcast), 0 where the signal has nothing."""
    grid = cells.select(*keys).distinct().crossJoin(counted(times.select("t").distinct()))
    return grid.join(signal, [*keys, "t"], "left").na.fill({"x": 0})


def zero_signal(cells: DataFrame, steps: int) -> DataFrame:
    return cells.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")))).withColumn("x", F.lit(0.0))


def steps(signal: DataFrame) -> DataFrame:
    """Length of the shortest dimension."""
    return signal.groupBy("dim").agg(F.max("t").alias("t")).agg((F.min("t") + 1).alias("steps"))


def snapshot(signal: DataFrame, t: int) -> DataFrame:
    return signal.filter(F.col("t") == t)


def append(signal: DataFrame, values: DataFrame) -> DataFrame:
    """The signal with one more step, of ``values`` (the signal's other columns): the step after the last one."""
    last = signal.agg(F.max("t")).first()[0]
    return signal.unionByName(values.withColumn("t", F.lit(0 if last is None else last + 1).cast("long")))


def lags(signal: DataFrame, most: int, least: int = 1, by: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(by, t, lag, x): the values ``least``..``most`` steps before each step; before the first one, 0."""
    w = Window.partitionBy(*by).orderBy("t")
    each = F.array(*[F.struct(F.lit(p).cast("long").alias("lag"), (F.coalesce(F.lag("x", p).over(w), F.lit(0)) if p else F.col("x")).alias("x")) for p in range(least, most + 1)])
    return signal.select(*by, "t", each.alias("ls")).select(*by, "t", F.explode("ls").alias("l")).select(*by, "t", "l.lag", "l.x")


def _applied(stack: DataFrame, lagged: DataFrame, at: Column | None = None) -> DataFrame:
    """(i, t, k, lag, s): each power of the stack on each lag, or with ``at`` (over k, lag) on matching lags only."""
    x = stack.join(lagged.select(F.col("cell_id").alias("j"), "t", "lag", "x"), "j")
    x = x if at is None else x.filter(at)
    return x.groupBy("i", "t", "k", "lag").agg(F.sum(F.col("val") * F.col("x")).alias("s"))


def topolms(lower: DataFrame, upper: DataFrame, signal: DataFrame, m: int) -> DataFrame:
    """Topo-LMS regressors after step t: (i, t, f, s) with f = 0..m for L_upper^(m-f) x_(t-m+f) and f = m+1..2m for
    L_lower^(2m+1-f) x_(t-2m+f). Zero features have no row."""
    on = F.col("k") == F.col("lag")
    up = _applied(A.powers(upper, m), lags(signal, m), on).select("i", "t", (m - F.col("k")).alias("f"), "s") if m else None
    now = signal.select(F.col("cell_id").alias("i"), "t", F.lit(m).cast("long").alias("f"), F.col("x").alias("s"))
    down = _applied(A.powers(lower, m), lags(signal, m - 1, 0), F.col("k") == F.col("lag") + 1).select("i", "t", (2 * m + 1 - F.col("k")).alias("f"), "s") if m else None
    return reduce(DataFrame.unionByName, [p for p in (up, now, down) if p is not None])


def ccvar(
    cells: DataFrame,
    signal: DataFrame,
    lower: DataFrame | None,
    upper: DataFrame | None,
    k_self: tuple[int, int],
    lag: int,
    below: tuple[DataFrame, DataFrame, int] | None = None,
    above: tuple[DataFrame, DataFrame, int] | None = None,
    bias: bool = True,
    first: int = 1,
) -> DataFrame:
    """CC-VAR features before step t: (i, t, block, k, lag, s), blocks in the order l, sl, su, u, b.

    ``below`` and ``above``: (boundary to this dimension, that dimension's signal, K); their blocks are L^k Bᵀ x of the
    cells below and L^k B x of those above. ``k_self``: powers of the lower and the upper Laplacian. A block exists
    only if its operator does.
    """
    parts = []
    if below is not None and lower is not None:
        b, x, k = below
        parts.append(("l", A.each_times(A.powers(lower, k, first), A.transpose(b)), x))
    if lower is not None:
        parts.append(("sl", A.powers(lower, k_self[0], first), signal))
    if upper is not None:
        parts.append(("su", A.powers(upper, k_self[1], first), signal))
    if above is not None and upper is not None:
        b, x, k = above
        parts.append(("u", A.each_times(A.powers(upper, k, first), b), x))
    out = [_applied(stack, lags(x, lag)).select("i", "t", F.lit(name).alias("block"), "k", "lag", F.col("s").cast("double").alias("s")) for name, stack, x in parts]
    if bias:
        one = cells.select(F.col(cells.columns[0]).alias("cell_id")).join(signal.select("cell_id", "t"), "cell_id").withColumnRenamed("cell_id", "i")
        zero = F.lit(0).cast("long")
        out.append(one.select("i", "t", F.lit("b").alias("block"), zero.alias("k"), zero.alias("lag"), F.lit(1.0).alias("s")))
    return reduce(DataFrame.unionByName, out)


def normalise(features: DataFrame, signal: DataFrame, agent: Callable[[str], Column] | None = None, b: float = 1.0) -> DataFrame:
    """Each feature column of a step over its norm (√0.001 for an empty one), times a scale: the norm of the latest
    values, or with ``b`` below 1 their running mean, scale_t = (1 - b) scale_(t-1) + b norm_t from 0.

    ``agent``: the agent of a cell, from the cell's column, where several agents' columns are told apart.
    """
    own = ["agent", "t"]
    agent = agent or (lambda _: F.lit(0))
    features = features.withColumn("agent", agent("i"))
    square = features.groupBy(*own, "block", "k", "lag").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    x = lags(signal, 1).withColumn("agent", agent("cell_id")).groupBy(*own).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("val"))
    x = (x if b == 1 else ewma(x, ["agent"], 1 - b)).withColumnRenamed("val", "scale")
    scaled = F.col("s") / F.sqrt(F.when(F.col("square") == 0, 0.001).otherwise(F.col("square"))) * F.col("scale")
    return features.join(square, [*own, "block", "k", "lag"]).join(x, own).select("i", "t", "block", "k", "lag", scaled.alias("s"))


def layout(powers: dict[str, int], lag: int, bias: bool = True) -> list[tuple[str, int, int]]:
    """(block, k, lag) of all feature columns, in order; ``powers``: of the blocks there are."""
    out = [(block, k, p) for block in ("l", "sl", "su", "u") if block in powers for k in range(1, powers[block] + 1) for p in range(1, lag + 1)]
    return out + [("b", 0, 0)] * bias


def numbered(features: DataFrame, columns: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """(i, t, f, s): feature columns numbered by ``columns``, or those there are by block order, power and lag."""
    if columns is not None:
        keys = features.sparkSession.createDataFrame([(*c, n) for n, c in enumerate(columns)], "block string, k long, lag long, f long")
        return features.join(F.broadcast(keys), ["block", "k", "lag"]).select("i", "t", "f", "s")
    at = F.array_position(F.array(*map(F.lit, ("l", "sl", "su", "u", "b"))), F.col("block"))
    keys = features.select("block", "k", "lag").distinct().withColumn("f", (F.row_number().over(Window.orderBy(at, "k", "lag")) - 1).cast("long"))
    return features.join(F.broadcast(keys), ["block", "k", "lag"]).select("i", "t", "f", "s")  # as many rows as columns


def gram(features: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """SᵀRS of each step: (t, f, g, val)."""
    return A.gram(features, ["t"], weight=weight)


def right_hand_side(features: DataFrame, signal: DataFrame) -> DataFrame:
    """Sᵀy of each step: (t, f, val)."""
    y = signal.select(F.col("cell_id").alias("i"), "t", F.col("x").alias("y"))
    return features.join(y, ["i", "t"]).groupBy("t", "f").agg(F.sum(F.col("s") * F.col("y")).alias("val"))


def ewma(series: DataFrame, keys: list[str], gamma: float, start: int = 0) -> DataFrame:
    """state_t = γ state_(t-1) + (1-γ) val_t from 0, for every key and step, in closed form: a running sum of
    val · γ^-t, rescaled. Steps are counted from ``start`` in segments in which γ^-t stays below 1e100; a segment starts
    from the end of the one before, and what is older weighs less than 1e-100."""
    if gamma == 0:
        return series
    length = max(1, int(100 / -math.log10(gamma))) if gamma < 1 else 1 << 62
    part = F.floor((F.col("t") - start) / F.lit(length))
    x = series.withColumn("part", part).withColumn("lift", F.pow(F.lit(gamma), F.col("part") * length + start - F.col("t")))
    w = Window.partitionBy(*keys, "part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("val", (1 - gamma) * F.sum(F.col("val") * F.col("lift")).over(w) / F.col("lift"))
    ends = x.groupBy(*keys, (F.col("part") + 1).alias("part")).agg(F.max_by("val", "t").alias("end"), F.max("t").alias("at"))
    carried = F.coalesce(F.col("end") * F.pow(F.lit(gamma), F.col("t") - F.col("at")), F.lit(0.0))
    return x.join(ends, [*keys, "part"], "left").withColumn("val", F.col("val") + carried).select(*series.columns)


def soft_threshold(x: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0)) + F.lit(0.0)  # no negative zero
