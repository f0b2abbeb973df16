"""Named extension points: assays, adapters, reducers, post-hoc methods, maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Assay:
    name: str
    role: str
    mappable: bool = False


#: The built-in assays and their roles.
ASSAYS = {
    a.name: a
    for a in (
        Assay("beta", "location", True), Assay("var", "variance", True), Assay("se", "stdev", True), Assay("t", "t"), Assay("z", "z"), Assay("F", "F"), Assay("df", "df"),
        Assay("df1", "df"), Assay("df2", "df"), Assay("n_eff", "n_eff"), Assay("p", "p"), Assay("chi2", "chi2"), Assay("logBF", "log_evidence"),
    )
}


@dataclass(frozen=True)
class Reducer:
    """A reducer: fun(cube, design, options) gives (cells, attachments)."""

    name: str
    fun: Callable
    requires: tuple[str, ...] = ("beta",)
    uses_design: bool = False
    estimands: str = "none"
    weight_mode: str = "unweighted"
    synthetic_variance: str = "allow_effect_only"
    deletion: str = "unsupported"
    provides: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Adapter:
    """A source: detect(source) gives a score from 0 to 1, read(source, **options) a cube."""

    name: str
    detect: Callable
    read: Callable
    priority: int = 0
    capabilities: dict = field(default_factory=dict)  # for information; Spark prunes and caches by itself


class Registry:
    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def register(self, name: str, item, overwrite: bool = False):
        if name in self.items and not overwrite:
            raise ValueError(f"{self.kind} {name!r} is already registered")
        self.items[name] = item
        return item

    def unregister(self, name: str):
        self.items.pop(name, None)

    def get(self, name: str):
        if name not in self.items:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.items))}")
        return self.items[name]

    def names(self) -> list[str]:
        return sorted(self.items)


reducers, posthocs, adapters, maps = (Registry(k) for k in ("reducer", "post-hoc method", "adapter", "map"))


def register_assay(name: str, role: str, mappable: bool = False) -> Assay:
    ASSAYS[name] = Assay(name, role, mappable)
    return ASSAYS[name]


def detect_adapter(source) -> Adapter:
    """The adapter of the highest score; ties go to the higher priority, then the earlier registration."""
    scored = [(-a.detect(source), -a.priority, i, a) for i, a in enumerate(adapters.items.values())]
    best = min(scored, key=lambda x: x[:3], default=None)
    if best is None or best[0] >= 0:
        raise ValueError(f"no adapter reads {source!r}")
    return best[3]


#: Short names of reducers.
ALIASES = {"fixed": "meta:fe", "random": "meta:re", "stouffer": "combine:stouffer", "fisher": "combine:fisher", "lancaster": "combine:lancaster"}


def reducer(name: str) -> Reducer:
    return reducers.get(ALIASES.get(name, name))


def list_assays(cube=None, reducer_name: str | None = None) -> list[tuple[str, str | None]]:
    """(assay, role) of a cube, or of what a reducer is declared to give; the role of an unknown assay is None."""
    names = reducer(reducer_name).provides if reducer_name else cube.assays
    return [(a, ASSAYS[a].role if a in ASSAYS else None) for a in dict.fromkeys(names)]
