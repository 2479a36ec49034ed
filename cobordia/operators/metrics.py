"""Forecast and disagreement metrics as aggregations and windows.

Predictions are (case_id, cluster_id, dim, cell_id, i, yhat), truth (dim, cell_id, i, y), parameters (case_id, agent, t,
idx, value). A metric that is undefined is null; a rolling mean is null from its first null on, as a mean over values
of which one is undefined would be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobordia.session import counted

STEP = ["case_id", "dim", "i"]


def aggregate(predictions: DataFrame) -> DataFrame:
    """Mean of overlapping predictions of a cell."""
    return predictions.groupBy(*STEP, "cell_id").agg(F.avg("yhat").alias("yhat"))


def with_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted cells only, with what came."""
    return predictions.join(truth, ["dim", "cell_id", "i"])


def _nmse(error: Column, energy: Column) -> Column:
    return F.when(energy > 0, error / energy)


def nmse(yhat: Column, y: Column) -> Column:
    return _nmse(F.sum((yhat - y) * (yhat - y)), F.sum(y * y))


def mae(yhat: Column, y: Column) -> Column:
    return F.avg(F.abs(yhat - y))


def mape(yhat: Column, y: Column) -> Column:
    """In percent, over cells with a value."""
    return F.avg(F.when(y != 0, F.abs((yhat - y) / y))) * 100


def tv_metrics(x: DataFrame, more: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Per step: tv_nmse, tv_mae and tv_mape, and ``more`` by their names, each an aggregate of its own as Pandas UDFs do not
    go with built-in ones."""
    own = (F.col("yhat"), F.col("y"))
    out = x.groupBy(*STEP).agg(nmse(*own).alias("tv_nmse"), mae(*own).alias("tv_mae"), mape(*own).alias("tv_mape"))
    for name, f in (more or {}).items():
        out = out.join(x.groupBy(*STEP).agg(f(*own).alias(name)), STEP)
    return out


def rolling_nmse(x: DataFrame, cells: DataFrame, steps: DataFrame) -> DataFrame:
    """Per cell cumulative squared error over cumulative energy, then the mean over cells with energy. A cell without
    a prediction at a step adds nothing there. ``steps``: (case_id, dim, i), as many rows as a timeline."""
    grid = cells.select("dim", "cell_id").join(counted(steps), "dim")
    e = F.col("yhat") - F.col("y")
    w = Window.partitionBy("case_id", "dim", "cell_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    y = grid.join(x.select(*STEP, "cell_id", (e * e).alias("e"), (F.col("y") * F.col("y")).alias("g")), [*STEP, "cell_id"], "left").na.fill({"e": 0, "g": 0})
    y = y.withColumn("ce", F.sum("e").over(w)).withColumn("cg", F.sum("g").over(w))
    return y.groupBy(*STEP).agg(F.avg(F.when(F.col("cg") != 0, F.col("ce") / F.col("cg"))).alias("rolling_nmse"))


def rolling(metric: DataFrame, value: str, name: str, keys: tuple[str, ...] = ("case_id", "dim"), at: str = "i") -> DataFrame:
    """Cumulative mean; null from the first null on."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return metric.select(*keys, at, F.when(F.count(value).over(w) == F.count("*").over(w), F.avg(value).over(w)).alias(name))


def common_length(params: DataFrame) -> DataFrame:
    """Parameters cut to the shortest vector of each case and step."""
    each = params.groupBy("case_id", "t", "agent").agg(F.max("idx").alias("last")).groupBy("case_id", "t").agg(F.min("last").alias("last"))
    return params.join(each, ["case_id", "t"]).filter("idx <= last").drop("last")


def disagreement(params: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(case_id, t) with self_disagreement and self_rms, and with a reference (t, idx, ref) also global_disagreement,
    centroid_to_global, global_rms and the latter two relative to the reference's norm."""
    x = common_length(params)
    mean = F.avg("value").over(Window.partitionBy("case_id", "t", "idx"))
    x = x.withColumn("d2", (F.col("value") - mean) * (F.col("value") - mean)).withColumn("mean", mean)
    if reference is not None:
        x = x.join(reference, ["t", "idx"]).withColumn("g2", (F.col("value") - F.col("ref")) * (F.col("value") - F.col("ref")))
    else:
        x = x.withColumn("g2", F.lit(0.0)).withColumn("ref", F.lit(0.0))
    sums = [F.sum("d2").alias("d2"), F.sum("g2").alias("g2"), F.count("*").alias("n")]
    sums += [F.sum((F.col("mean") - F.col("ref")) * (F.col("mean") - F.col("ref"))).alias("c2"), F.sum(F.col("ref") * F.col("ref")).alias("r2")]
    agents = x.groupBy("case_id", "t", "agent").agg(*sums)
    one = F.count("*") <= 1
    norm = F.greatest(F.sqrt(F.max("r2")), F.lit(1e-12))
    out = [
        F.when(one, 0.0).otherwise(F.sum("d2") / F.sum("n")).alias("self_disagreement"),
        F.when(one, 0.0).otherwise(F.sqrt(F.avg("d2"))).alias("self_rms"),
    ]
    if reference is not None:
        out += [
            F.avg(F.sqrt("g2")).alias("global_disagreement"),
            F.sqrt(F.max("c2")).alias("centroid_to_global"),
            (F.sqrt(F.max("c2")) / norm).alias("centroid_to_global_relative"),
            F.sqrt(F.avg("g2")).alias("global_rms"),
            (F.sqrt(F.avg("g2")) / norm).alias("global_rms_relative"),
        ]
    return agents.groupBy("case_id", "t").agg(*out)


def interface_cells(interface: DataFrame) -> DataFrame:
    return interface.select("dim", "cell_id").distinct()


def interface_nmse(predictions: DataFrame, truth: DataFrame, interface: DataFrame) -> DataFrame:
    """NMSE over interface cells, per dimension and pooled over dimensions with energy (dim null); a cell without a
    prediction counts as predicted 0."""
    cells = interface_cells(interface).join(truth, ["dim", "cell_id"])
    cases = predictions.select("case_id", "i").distinct()
    x = cells.join(cases, "i").join(predictions.select(*STEP, "cell_id", "yhat"), [*STEP, "cell_id"], "left").na.fill({"yhat": 0})
    e = F.col("yhat") - F.col("y")
    each = x.groupBy(*STEP).agg(F.sum(e * e).alias("e"), F.sum(F.col("y") * F.col("y")).alias("g")).filter("g > 0")
    each = each.select("case_id", "dim", "i", "e", "g")
    both = each.groupingSets([STEP, ["case_id", "i"]], *STEP).agg(F.sum("e").alias("e"), F.sum("g").alias("g"))
    return both.select(*STEP, (F.col("e") / F.col("g")).alias("interface_nmse"))


def tail_mean(metric: DataFrame, value: str, keys: tuple[str, ...] = ("case_id", "dim"), at: str = "i", fraction: float = 0.1, finite_first: bool = False) -> DataFrame:
    """Mean of the defined values in the last ``fraction`` (rounded up) of a series; with ``finite_first`` of the last
    part of its defined values."""
    x = metric.filter(F.col(value).isNotNull()) if finite_first else metric
    w = Window.partitionBy(*keys)
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.col(at).desc()))).withColumn("n", F.count("*").over(w))
    return x.filter(F.col("rank") <= F.ceil(F.col("n") * fraction)).groupBy(*keys).agg(F.avg(value).alias("tail_mean"))


def last_value(metric: DataFrame, value: str, keys: tuple[str, ...] = ("case_id", "dim"), at: str = "i") -> DataFrame:
    return metric.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, at).alias("last"))


def comparison_table(long: DataFrame, cases: list[str]) -> DataFrame:
    """(metric, case_id, value) -> one column per case."""
    return long.groupBy("metric").pivot("case_id", cases).agg(F.first("value"))


def at_horizon(forecasts: DataFrame, h: int) -> DataFrame:
    """Forecasts of the horizon, or of the longest one there is."""
    most = forecasts.groupBy("case_id").agg(F.max("horizon").alias("most"))
    return forecasts.join(most, "case_id").filter(F.col("horizon") == F.least(F.lit(h), F.col("most"))).drop("most")


def persistence(signal: DataFrame, h: int) -> DataFrame:
    """Forecast of step t + h made at t: the value at t."""
    if h < 1:
        raise ValueError("the horizon must be 1 or more")
    return signal.select("dim", "cell_id", (F.col("t") + h).alias("t_eval"), F.col("t").alias("t_made"), F.col("x").cast("double").alias("yhat"))
