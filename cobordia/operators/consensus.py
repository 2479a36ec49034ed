"""Parameter mixing between agents, on tables (agent, idx, value) and weights (src, dst, w), self as src = dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mix_atc(weights: DataFrame, params: DataFrame) -> DataFrame:
    """Adapt-then-combine: θ_i = Σ_j w_ij θ_j over what arrived; a missing neighbour's weight is not made up for."""
    x = weights.join(params.withColumnRenamed("agent", "dst"), "dst")
    return x.groupBy(F.col("src").alias("agent"), "idx").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def kgt_aux(params: DataFrame, history: DataFrame, k: float = 1.0, c: float = 1.0) -> DataFrame:
    """z = (history - θ) / (K c); history starts at 0."""
    old = history.select("agent", "idx", F.col("value").alias("old"))
    return params.join(old, ["agent", "idx"], "left").select("agent", "idx", ((F.coalesce("old", F.lit(0.0)) - F.col("value")) / (k * c)).alias("value"))


def kgt_correction(correction: DataFrame, aux: DataFrame, weights: DataFrame) -> DataFrame:
    """C ← C - z_i + Σ_j w_ij z_j, oneself included."""
    mixed = mix_atc(weights, aux).withColumnRenamed("value", "mixed")
    x = correction.join(aux.withColumnRenamed("value", "z"), ["agent", "idx"]).join(mixed, ["agent", "idx"])
    return x.select("agent", "idx", (F.col("value") - F.col("z") + F.col("mixed")).alias("value"))


def kgt_mix(weights: DataFrame, params: DataFrame, history: DataFrame, aux: DataFrame, k: float = 1.0, c: float = 1.0, s: float = 1.0, neighbour_base: str = "current") -> DataFrame:
    """θ_i = w_ii (history_i - Kcs z_i) + Σ_j w_ij (θ_j - Kcs z_j); with ``neighbour_base="history"`` neighbours start
    from their history too."""
    old = history.select("agent", "idx", F.col("value").alias("old"))
    x = params.join(old, ["agent", "idx"], "left").join(aux.select("agent", "idx", F.col("value").alias("z")), ["agent", "idx"])
    x = x.select(F.col("agent").alias("dst"), "idx", "value", F.coalesce("old", F.lit(0.0)).alias("old"), "z")
    own = (F.col("src") == F.col("dst")) | F.lit(neighbour_base == "history")
    base = F.when(own, F.col("old")).otherwise(F.col("value"))
    return weights.join(x, "dst").groupBy(F.col("src").alias("agent"), "idx").agg(F.sum(F.col("w") * (base - k * c * s * F.col("z"))).alias("value"))


def kgt_gradient(gradient: Column, correction: Column, c: float = 1.0) -> Column:
    return c * (gradient + correction)
