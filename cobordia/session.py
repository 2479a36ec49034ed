"""Session helpers shared by every layer: readers, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's Parquet table ``name`` under ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's shared folder, or in local mode one of our own where none is named."""
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", "")
        if not at:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="cobordia-checkpoint-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends, lost executors lose nothing."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, at_most: int = 1 << 22) -> DataFrame:
    """``df`` marked for broadcast, after its rows were counted and found to be at most ``at_most``: timelines, mostly."""
    if df.limit(at_most + 1).count() > at_most:
        raise ValueError(f"more than {at_most} rows are too many to send to every task")
    return F.broadcast(df)


def _by_keys(df: DataFrame, keys: DataFrame, column: str, kind: str, at_most: int) -> DataFrame:
    small = keys.limit(at_most + 1).count() <= at_most
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), column, kind)


def keep_keys(df: DataFrame, keys: DataFrame, column: str, at_most: int = 1 << 20) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``keys`` (distinct, settled).

    The key side is broadcast only after its rows were counted and found to be at most ``at_most``
    (8 bytes each); beyond it both sides are shuffled.
    """
    return _by_keys(df, keys, column, "left_semi", at_most)


def drop_keys(df: DataFrame, keys: DataFrame, column: str, at_most: int = 1 << 20) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in ``keys``, or null; otherwise as ``keep_keys``."""
    return _by_keys(df, keys, column, "left_anti", at_most)


#: Arrow batches between the JVM and Python: rows and bytes at most. Larger settings of the session are lowered.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and idle memory counts."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, rows: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size, which ends each task by releasing memory."""
    conf = df.sparkSession.conf
    for key, most in BATCHES.items():
        held = int("".join(filter(str.isdigit, conf.get(key, str(most)))) or most)
        if held > most or held == 0:
            conf.set(key, str(most))

    def task(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def releasing(rows: Callable) -> Callable:
    """``rows`` of one group (``applyInArrow``), which ends each group by releasing memory."""

    def group(x):
        try:
            return rows(x)
        finally:
            release()

    return group
