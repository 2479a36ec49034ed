"""Extensions by name, which plans name and runners look up.

* "metric": (prediction, truth) columns to an aggregate over a step's predicted cells: an expression of built-in functions or
  a grouped-aggregate Pandas UDF. A plan's ``metrics`` are columns beside the built-in errors of its case.
* "imputer": (came, blank, last, keys) to (keys, t, x): what others' cells are taken to be at every step. ``came``: (keys, t,
  x), with a 0 at the first step where nothing had come; ``blank``: (keys, t), each cell's first step; ``last``: one row
  with the last step. A plan's ``imputer`` is one of them, or "labels", which needs the complex.
* "mixing" on tables of parameters, and "table" for metrics that are functions from DataFrames to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from cobordia.operators import consensus, exchange, metrics

Extension = Callable[..., DataFrame | Column]
_known: dict[tuple[str, str], Extension] = {}


def register(kind: str, name: str) -> Callable[[Extension], Extension]:
    """Decorator: make a function available as ``get(kind, name)``; a name is given once."""

    def put(f: Extension) -> Extension:
        if (kind, name) in _known:
            raise ValueError(f"there is a {kind} {name} already")
        _known[kind, name] = f
        return f

    return put


def get(kind: str, name: str) -> Extension:
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} {name}; there are {', '.join(names(kind)) or 'none'}")
    return _known[kind, name]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _known if k == kind)


for _kind, _name, _f in (
    ("mixing", "atc", consensus.mix_atc),
    ("mixing", "kgt", consensus.kgt_mix),
    ("imputer", "zero", exchange.zero_between),
    ("imputer", "hold", exchange.held_between),
    ("metric", "tv_nmse", metrics.nmse),
    ("metric", "tv_mae", metrics.mae),
    ("metric", "tv_mape", metrics.mape),
    ("table", "rolling_nmse", metrics.rolling_nmse),
    ("table", "disagreement", metrics.disagreement),
    ("table", "interface_nmse", metrics.interface_nmse),
):
    register(_kind, _name)(_f)
