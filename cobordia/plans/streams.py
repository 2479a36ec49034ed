"""Streaming queries, run to the end of the files there are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobordia.session import use_checkpoints
from cobordia.streaming import agents as S
from cobordia.streaming import inbox as I


def _place(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _drain(df: DataFrame, at: str, sink, mode: str) -> None:
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each event type's learner after all closed hours."""
    at = _place(spark)
    hours = f"{at}/hours"
    _drain(S.buckets(S.read_events(spark, sf_dir)), at + "/a", lambda d, k: d.write.mode("overwrite").parquet(f"{hours}/batch={k}"), "append")
    steps = spark.readStream.schema("agent string, t long, x double").option("recursiveFileLookup", "true").parquet(hours)
    _drain(S.learn_stream(steps), at + "/b", lambda d, k: d.write.mode("overwrite").parquet(f"{at}/out/batch={k}"), "update")
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy("agent").agg(F.max(F.struct("steps", "theta", "last")).alias("s")).select("agent", "s.steps", "s.theta", "s.last")


def stream_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with all event types exchanging parameters after every micro-batch, in equal weights."""
    at = _place(spark)
    sink = S.ExchangeSink(f"{at}/state")
    last = []

    def batch(d: DataFrame, k: int) -> None:
        sink(d, k)
        last.append(k)

    _drain(S.buckets(S.read_events(spark, sf_dir)), at, batch, "append")
    return sink.state(spark, max(last, default=-1))


def traffic(events: DataFrame) -> DataFrame:
    """Events as messages of their kind to their user, who reads all that came with each purchase."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("agent"), at.alias("t"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("reads"), F.col("event_type").alias("source"), "value")


def stream_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users read of their inboxes: each message once, the latest of its kind."""
    at, before = _place(spark), spark.conf.get(I.STORE[0])
    spark.conf.set(*I.STORE)
    try:
        _drain(I.read_once(traffic(S.read_events(spark, sf_dir))), at, lambda d, k: d.write.mode("overwrite").parquet(f"{at}/out/batch={k}"), "append")
    finally:
        spark.conf.set(I.STORE[0], before)
    return spark.read.schema(I.READ).parquet(f"{at}/out").select(*I.READ.names)


QUERIES = {"stream_agents": stream_agents, "stream_exchange": stream_exchange, "stream_inbox": stream_inbox}
SQL: dict[str, str] = {
    "stream_inbox": """
WITH e AS (SELECT user_id AS agent, epoch_us(ts) AS t, event_id AS id, event_type AS source, value, event_type = 'purchase' AS reads FROM events),
m AS (SELECT *, min(CASE WHEN reads THEN (t, id) END) OVER (PARTITION BY agent ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM e),
l AS (SELECT agent, next, source, max((t, id)) AS last FROM m WHERE NOT reads AND next IS NOT NULL GROUP BY 1, 2, 3)
SELECT l.agent, l.next[1] AS read_at, l.next[2] AS read_id, l.source, m.t AS sent_at, m.value FROM l JOIN m ON m.agent = l.agent AND (m.t, m.id) = l.last AND m.source = l.source
"""
}
