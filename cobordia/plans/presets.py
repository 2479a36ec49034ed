"""Parameters of experiments: defaults, named presets and cases that override parts of a plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from cobordia.functions import registry
from cobordia.operators.features import layout
from cobordia.operators.learning import Rule


@dataclass(frozen=True)
class Clustering:
    """``kind``: "given" communities, "modularity", "hops" (of ``d`` hops), or "edges" (an agent per edge)."""

    kind: str = "given"
    best_n: int = 7
    resolution: float = 1.5
    dim: int = 1
    q_hop: int = 1
    d: int = 20


@dataclass(frozen=True)
class Model:
    """CC-VAR: enabled ``dims``, ``lag`` P, ``powers`` K and smoothing ``mu`` per dimension (a pair: lower and upper),
    feature normalisation with its running factor ``b``; Topo-LMS: memory ``m``."""

    kind: str = "ccvar"
    horizon: int = 1
    dims: tuple[int, ...] = (0, 1, 2)
    lag: int = 2
    powers: tuple = (2, (2, 2), 2)
    mu: tuple = (0, (0, 0), 0)
    normalise: bool = False
    b: float = 1.0
    bias: bool = True
    m: int = 2

    def __post_init__(self) -> None:
        if self.kind not in ("ccvar", "topolms"):
            raise ValueError(f"no model {self.kind}")
        if self.horizon < 1 or self.lag < 1:
            raise ValueError("horizons and lags are 1 or more")

    def pair(self, values: tuple, dim: int) -> tuple:
        """The lower and the upper value of a dimension; a single number stands for both."""
        k = values[dim]
        return tuple(k) if isinstance(k, tuple | list) else (k, k)

    def columns(self, dim: int, below: bool, above: bool) -> list[tuple[str, int, int]]:
        """Feature columns of a dimension, given whether there is a boundary below and above it."""
        low, up = self.pair(self.powers, dim)
        blocks = {"sl": low} if below else {}
        blocks |= {"su": up} if above else {}
        blocks |= {"l": low} if below and dim - 1 in self.dims else {}
        blocks |= {"u": up} if above and dim + 1 in self.dims else {}
        return layout(blocks, self.lag, self.bias)


@dataclass(frozen=True)
class Plan:
    """``imputer``: what agents take for others' cells between exchanges: "hold", "zero", "labels" or one that was registered.
    ``metrics``: registered errors to be computed beside the built-in ones. ``inside``: agents
    see no more than what they predict. ``data_sends``: in place of the data clock, a condition in SQL on (t, agent): does
    the agent send its data at that step. ``interface``: what agents take for the cells they share at an exchange, the
    "same" value that all have, or the "averaged" one of their own copy and the neighbour's."""

    clustering: Clustering = field(default_factory=Clustering)
    model: Model = field(default_factory=Model)
    rule: Rule = field(default_factory=lambda: Rule(mixing="atc"))
    data_clock: int = 10
    imputer: str = "hold"
    inside: bool = False
    data_sends: str | None = None
    interface: str = "same"
    metrics: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.interface not in ("same", "averaged"):
            raise ValueError(f"no interface {self.interface}")
        if self.imputer == "labels" and self.data_sends:
            raise ValueError("labels are propagated between the ticks of one clock")
        if self.data_clock < 1:
            raise ValueError("clocks tick every step or less often")
        if self.imputer not in ("labels", *registry.names("imputer")):
            raise ValueError(f"no imputer {self.imputer}")
        for m in self.metrics:
            registry.get("metric", m)

    def columns(self) -> dict[str, str]:
        """Run metadata, flat, as columns for a result: C_data, C_param, K, ... in the order of the plan's parts."""
        flat = {f"{part}_{k}": v for part in ("clustering", "model", "rule") for k, v in asdict(getattr(self, part)).items()}
        return {k: str(v) for k, v in (flat | {k: getattr(self, k) for k in ("data_clock", "imputer", "inside", "data_sends", "interface")}).items()}


def merged(plan, **changes):
    """A plan with some parts changed; dictionaries change parts of parts."""
    return replace(plan, **{k: merged(getattr(plan, k), **v) if isinstance(v, dict) else v for k, v in changes.items()})


PRESETS = {
    "default": Plan(),
    "hops": merged(Plan(), clustering={"kind": "hops", "q_hop": 5}),
    "modularity": merged(Plan(), clustering={"kind": "modularity"}),
    "communication": merged(Plan(), data_clock=1, rule={"clock": 100}),
    "comparative": merged(Plan(), data_clock=1, rule={"clock": 1}, clustering={"kind": "edges"}, model={"dims": (1,)}),
    "local": merged(Plan(), rule={"mixing": "none"}, data_clock=1, inside=True),
    "global": merged(Plan(), rule={"mixing": "none"}),
}
