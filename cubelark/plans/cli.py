"""Command line: probe, plan, preview, run, list."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .. import registry
from ..operators.verbs import MaskPolicy
from ..sources import tabular
from . import plan as P


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cubelark", description="Group statistics over labelled cubes")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("probe", "plan", "preview", "run"):
        one = sub.add_parser(name)
        one.add_argument("source", help="a table, or a plan saved as JSON")
        for key in ("sample", "subject", "contrast", "order"):
            one.add_argument(f"--{key}-column", default=None)
        one.add_argument("--assay", action="append", default=[], metavar="NAME=COLUMN")
        for key in ("sample", "subject", "contrast"):
            one.add_argument(f"--{key}", action="append", help=f"keep this {key}")
        one.add_argument("--mask", action="append", default=[], metavar="SCOPE:RULE[:THRESHOLD]")
        one.add_argument("--derive", action="append", default=[])
        one.add_argument("--reduce", default=None)
        one.add_argument("--formula", default=None)
        one.add_argument("--posthoc", action="append", default=[])
        one.add_argument("--out", default=None)
        one.add_argument("--format", default="parquet", choices=("parquet", "csv", "bundle", "nifti"))
        one.add_argument("--save-plan", default=None)
        one.add_argument("--rows", type=int, default=20)
        one.add_argument("--dry-run", action="store_true")
        one.add_argument("--json", action="store_true")
    lists = sub.add_parser("list")
    lists.add_argument("what", choices=("reducers", "posthoc", "adapters", "assays"))
    lists.add_argument("--json", action="store_true")
    return top


def build(args) -> P.Plan:
    """The plan of the flags, in the fixed order subset, mask, derive, reduce, posthoc, write."""
    if args.source.endswith(".json"):
        return P.load_plan(args.source)
    options = {k: v for k, v in (("sample", args.sample_column), ("subject", args.subject_column), ("contrast", args.contrast_column), ("order", args.order_column)) if v}
    if args.assay:
        options["assays"] = dict(a.split("=", 1) for a in args.assay)
    out = P.plan(args.source, **options)
    chosen = {k: v for k in ("sample", "subject", "contrast") if (v := getattr(args, k))}
    if chosen:
        out = out.subset(**chosen)
    if args.mask:
        parts = [m.split(":") for m in args.mask]
        out = out.mask(*[MaskPolicy(p[0], p[1], float(p[2]) if len(p) > 2 else 0.95) for p in parts])
    if args.derive:
        out = out.derive(args.derive)
    if args.reduce:
        out = out.reduce(args.reduce, **({"formula": args.formula} if args.formula else {}))
    for method in args.posthoc:
        out = out.posthoc(method)
    return out.write_out(args.out, args.format) if args.out else out


def main(argv=None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    say = lambda value: print(json.dumps(value, default=str) if args.json else value if isinstance(value, str) else json.dumps(value, indent=1, default=str))
    try:
        if args.command == "list":
            say({"reducers": registry.reducers.names(), "posthoc": registry.posthocs.names(), "adapters": registry.adapters.names(), "assays": sorted(registry.ASSAYS)}[args.what])
            return 0
        made = build(args)
        if args.save_plan:
            made.save(args.save_plan)
        if args.command == "plan" or args.dry_run:
            issues = made.validate()
            say({"plan": made.explain().split("\n"), "digest": made.digest(), "issues": issues})
            return int(bool(issues))
        spark = spark or SparkSession.builder.getOrCreate()
        if args.command == "probe":
            cube = tabular.cube(spark, made.source, **made.options)
            say({"assays": list(cube.assays), "samples": cube.size("sample"), "subjects": cube.size("subject"), "contrasts": cube.size("contrast"), "space": cube.space.kind})
            return 0
        cube = made.preview(spark) if args.command == "preview" else made.compute(spark)
        if args.command == "preview" or not args.out:
            say([r.asDict() for r in cube.df.limit(args.rows).collect()])
        return 0
    except (ValueError, KeyError, TypeError) as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
