"""Sources: signals and topology from Parquet, arrays or matrix files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobordia.operators.features import centre

SIGNAL, BOUNDARY = "dim long, cell_id long, t long, x double", "dim long, i long, j long, val long"
DIMS = {"l": 0, "s": 1, "u": 2}


def from_matrix(spark: SparkSession, matrix: np.ndarray, dim: int) -> DataFrame:
    """A dense (cells x steps) signal held by the driver, in long form."""
    cell, t = np.indices(matrix.shape)
    x = pd.DataFrame({"dim": dim, "cell_id": cell.ravel(), "t": t.ravel(), "x": np.asarray(matrix, float).ravel()})
    return spark.createDataFrame(x, SIGNAL)


def from_boundary(spark: SparkSession, matrix: np.ndarray, dim: int) -> DataFrame:
    """A dense boundary matrix B_dim, as its non-zero entries."""
    i, j = np.nonzero(matrix)
    return spark.createDataFrame(pd.DataFrame({"dim": dim, "i": i, "j": j, "val": np.rint(matrix[i, j]).astype(np.int64)}), BOUNDARY)


def from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], centred: bool = True) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(signal, boundaries) of arrays ``l``, ``s``, ``u`` (steps x cells; ``l`` and ``u`` may be missing) and ``B1``, ``B2``."""
    if "s" not in arrays:
        raise KeyError("an edge signal 's' is needed")
    parts = [from_matrix(spark, np.asarray(arrays[k]).T, d) for k, d in DIMS.items() if k in arrays]
    signal = parts[0]
    for p in parts[1:]:
        signal = signal.unionByName(p)
    b = {k: from_boundary(spark, np.asarray(arrays[f"B{k}"]), k).select("i", "j", "val") for k in (1, 2) if f"B{k}" in arrays}
    if not b:
        raise KeyError("a boundary 'B1' or 'B2' is needed")
    return centre(signal) if centred else signal, b


def from_npz(spark: SparkSession, path: str, centred: bool = True) -> tuple[DataFrame, dict[int, DataFrame]]:
    """As ``from_arrays``, from one NumPy archive that any reader of Spark can open."""
    import io

    with np.load(io.BytesIO(_bytes(spark, path))) as arrays:
        return from_arrays(spark, dict(arrays), centred)


def from_matlab(spark: SparkSession, path: str, centred: bool = True) -> tuple[DataFrame, dict[int, DataFrame]]:
    """As ``from_arrays``, from a MATLAB file; needs SciPy. Entries of the file about itself are left out."""
    try:
        from scipy.io import loadmat
    except ImportError as missing:
        raise RuntimeError("reading .mat files needs SciPy") from missing
    import io

    arrays = {k: v for k, v in loadmat(io.BytesIO(_bytes(spark, path))).items() if not k.startswith("__")}
    return from_arrays(spark, arrays, centred)


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def from_parquet(spark: SparkSession, signal: str, boundary: str, centred: bool = True) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(signal, boundaries) of long tables (dim, cell_id, t, x) and (dim, i, j, val); partition both by ``dim``."""
    s, b = spark.read.parquet(signal), spark.read.parquet(boundary)
    return centre(s) if centred else s, {k: b.filter(F.col("dim") == k).select("i", "j", "val") for k in (1, 2)}


def replay(signal: DataFrame, start: int = 0):
    """Snapshots in order of time, one DataFrame a step; the last step is the last."""
    last = signal.agg(F.max("t")).first()[0]
    for t in range(start, -1 if last is None else last + 1):
        yield signal.filter(F.col("t") == t)
