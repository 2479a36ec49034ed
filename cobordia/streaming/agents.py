"""Streaming forms: events bucketed into steps, per-agent state, and exchange between agents at a barrier per batch.

``learn_stream`` keeps one scalar auto-regressive learner per agent as keyed state (agents that never exchange).
``ExchangeSink`` is for agents that do: keyed state cannot see another key, so each micro-batch updates all agents,
joins their parameters with the mixing weights and writes state and history under the batch id; a batch that is run
again after a failure overwrites its own files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cobordia.session import table

RATE, FORGET = 0.5, 0.98
OUT = "agent string, steps long, theta double, last double"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, a file or a folder of files, as a stream; the path is what the Parquet reader takes, so it may be in
    any store."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*.parquet")


def buckets(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(agent, t, x): hourly sums per event type; events later than ``late`` are dropped with their closed window."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("agent"))
    return own.agg(F.sum("value").alias("x")).select("agent", F.unix_timestamp(F.col("window.start")).alias("t"), "x")


def step(theta: float, phi: float, r: float, before: float, x: float) -> tuple[float, float, float]:
    """One online step of x_t = θ x_(t-1): the state of second order, then a gradient step of its size."""
    phi, r = FORGET * phi + (1 - FORGET) * before * before, FORGET * r + (1 - FORGET) * before * x
    return theta - RATE * (phi * theta - r) / (1e-4 + phi), phi, r


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    theta, phi, r, before, steps = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, 0)
    rows = sorted(((t, x) for b in batches for t, x in zip(b.t, b.x, strict=True)))
    for _, x in rows:
        theta, phi, r = step(theta, phi, r, before, float(x))
        before, steps = float(x), steps + 1
    state.update((theta, phi, r, before, steps))
    yield pd.DataFrame({"agent": [key[0]], "steps": [steps], "theta": [theta], "last": [before]})


def learn_stream(steps: DataFrame) -> DataFrame:
    """(OUT) after each micro-batch, for agents on their own."""
    return steps.groupBy("agent").applyInPandasWithState(_update, OUT, "theta double, phi double, r double, last double, steps long", "update", GroupStateTimeout.NoTimeout)


class ExchangeSink:
    """``foreachBatch`` sink: local steps on every agent, then adapt-then-combine mixing, state under ``path``. Without
    ``weights`` (src, dst, w) all agents take the mean of all, which needs no pairs of them."""

    def __init__(self, path: str, weights: DataFrame | None = None) -> None:
        self.path, self.weights = path, weights
        self.schema = "agent string, theta double, phi double, r double, last double, steps long"

    def state(self, spark: SparkSession, batch: int) -> DataFrame:
        if batch < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = self.state(spark, batch - 1)

        def local(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            theta, phi, r, last, steps = tuple(old.iloc[0][["theta", "phi", "r", "last", "steps"]]) if len(old) else (0.0, 0.0, 0.0, 0.0, 0)
            agent = old.agent.iloc[0] if len(old) else new.agent.iloc[0]
            for x in new.sort_values("t").x:
                theta, phi, r = step(theta, phi, r, last, float(x))
                last, steps = float(x), steps + 1
            return pd.DataFrame({"agent": [agent], "theta": [theta], "phi": [phi], "r": [r], "last": [last], "steps": [int(steps)]})

        moved = rows.groupBy("agent").cogroup(before.groupBy("agent")).applyInPandas(lambda a, b: local(a, b), self.schema)
        if self.weights is None:
            mixed = moved.select("agent").join(F.broadcast(moved.agg(F.avg("theta").alias("mixed"))), how="cross")  # one row
        else:
            sent = moved.select(F.col("agent").alias("dst"), F.col("theta").alias("sent"))
            mixed = self.weights.join(sent, "dst").groupBy(F.col("src").alias("agent")).agg(F.sum(F.col("w") * F.col("sent")).alias("mixed"))
        out = moved.join(mixed, "agent", "left").withColumn("theta", F.coalesce("mixed", "theta")).select("agent", "theta", "phi", "r", "last", "steps")
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
