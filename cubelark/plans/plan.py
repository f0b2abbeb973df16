"""Lazy plans: an immutable list of verbs over a source; order is meaning, nothing is re-ordered."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from ..cube import Cube
from ..operators import export, posthoc, verbs
from ..operators import reduce as reducing
from ..operators.maps import align, map_to
from ..registry import posthocs, reducer
from ..sources import tabular

VERBS = ("subset", "derive", "mask", "map_to", "align", "reduce", "posthoc", "write_out")


@dataclass(frozen=True)
class Node:
    verb: str
    args: dict

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.verb, self.args], sort_keys=True, default=_plain).encode()).hexdigest()[:16]


def _plain(value):
    if isinstance(value, verbs.MaskPolicy):
        if value.rule == "custom":
            raise TypeError("a custom mask cannot be saved")
        return {"scope": value.scope, "rule": value.rule, "threshold": value.threshold}
    raise TypeError(f"{type(value).__name__} cannot be saved")


@dataclass(frozen=True)
class Plan:
    """Verbs to run on a source when ``compute`` is called; each verb gives a new plan."""

    source: object
    options: dict
    nodes: tuple[Node, ...] = ()

    def _add(self, verb: str, **args) -> "Plan":
        return replace(self, nodes=(*self.nodes, Node(verb, args)))

    def subset(self, **axes):
        return self._add("subset", **axes)

    def derive(self, what=("var", "se", "t", "z"), overwrite=False):
        return self._add("derive", what=[what] if isinstance(what, str) else list(what), overwrite=overwrite)

    def mask(self, *policies):
        return self._add("mask", policies=list(policies))

    def map_to(self, edges, **options):
        return self._add("map_to", edges=edges, **options)

    def align(self, family, **options):
        return self._add("align", family=family, **options)

    def reduce(self, method, **options):
        reducer(method)
        return self._add("reduce", method=method, **options)

    def posthoc(self, method, **options):
        posthocs.get(method)
        return self._add("posthoc", method=method, **options)

    def write_out(self, path, format="parquet", **options):
        return self._add("write_out", path=path, format=format, **options)

    def validate(self) -> list[str]:
        """What would fail before any data is read."""
        issues = [f"unknown verb {n.verb!r}" for n in self.nodes if n.verb not in VERBS]
        reduced = [i for i, n in enumerate(self.nodes) if n.verb == "reduce"]
        if len(reduced) > 1:
            issues.append("a plan reduces once")
        for n in self.nodes:
            if n.verb == "reduce" and n.args.get("formula") and not reducer(n.args["method"]).uses_design:
                issues.append(f"{n.args['method']} takes no formula")
        return issues

    def run(self, spark: SparkSession) -> tuple[Cube, list[Node]]:
        writes = []
        cube = tabular.cube(spark, self.source, **self.options)
        for node in self.nodes:
            args = dict(node.args)
            if node.verb == "write_out":
                writes.append(node)
            elif node.verb == "mask":
                cube = verbs.mask(cube, *args["policies"])
            elif node.verb == "reduce":
                cube = reducing.reduce(cube, args.pop("method"), **args)
            elif node.verb == "posthoc":
                cube = posthoc.posthoc(cube, args.pop("method"), **args)
            else:
                cube = {"subset": verbs.subset, "derive": verbs.derive, "map_to": map_to, "align": align}[node.verb](cube, **args)
        return cube, writes

    def compute(self, spark: SparkSession, assays=None) -> Cube:
        """The final cube. Writes, wherever they stand, get the final result. ``assays`` reads raw measures and runs no verb."""
        if assays:
            cube = tabular.cube(spark, self.source, **self.options)
            return cube.with_df(cube.df.select("sample", "subject", "contrast", *assays))
        cube, writes = self.run(spark)
        for node in writes:
            args = dict(node.args)
            export.write_out(cube, args.pop("path"), args.pop("format"), **args)
        return cube

    def preview(self, spark: SparkSession, n: int = 3) -> Cube:
        """The plan on the first n samples only."""
        first = verbs.preview(tabular.cube(spark, self.source, **self.options), n)
        return replace(self, source=first, options={}, nodes=tuple(x for x in self.nodes if x.verb != "write_out")).run(spark)[0]

    def explain(self) -> str:
        return "\n".join([f"source: {self.source if isinstance(self.source, str) else type(self.source).__name__}"] + [f"{i + 1}. {n.verb} {n.args}" for i, n in enumerate(self.nodes)])

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([str(self.source), [n.digest() for n in self.nodes]]).encode()).hexdigest()[:16]

    def save(self, path: str) -> None:
        """Plain JSON; plans over tables, custom masks, maps or callables are refused."""
        if not isinstance(self.source, str):
            raise TypeError("only a plan over a path can be saved")
        nodes = json.loads(json.dumps([[n.verb, n.args] for n in self.nodes], default=_plain))
        with open(path, "w") as f:
            json.dump({"source": self.source, "options": self.options, "nodes": nodes, "digest": self.digest()}, f, indent=1)


def load_plan(path: str) -> Plan:
    with open(path) as f:
        found = json.load(f)
    nodes = []
    for verb, args in found["nodes"]:
        if verb == "mask":
            args = {"policies": [verbs.MaskPolicy(**p) for p in args["policies"]]}
        nodes.append(Node(verb, args))
    plan = Plan(found["source"], found["options"], tuple(nodes))
    if plan.digest() != found["digest"]:
        warnings.warn("the plan's digest differs from its content")
    return plan


def plan(source, **options) -> Plan:
    """A plan over a path, a DataFrame or a cube; a plan stays as it is."""
    return source if isinstance(source, Plan) else Plan(source, options)


