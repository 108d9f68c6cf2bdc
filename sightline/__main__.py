"""Command line: run the stages over stored tables, decide a stored gate again, publish a run."""

from __future__ import annotations

import argparse
import sys

from sightline import runs
from sightline.config import parsed, settings
from sightline.operators import decisions
from sightline.session import session
from sightline.sources import artifacts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sightline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run all stages that are not done; exit code 3 if the gate says no")
    for name in ("samples", "gt", *runs.MODELS):
        run.add_argument(f"--{name}", required=True, help="a Parquet table")
    run.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting; the value is JSON")
    run.add_argument("--until", choices=list(runs.STAGES))
    gate = commands.add_parser("gate", help="decide a run's gate again from its stored tables; exit code 3 if it says no")
    gate.add_argument("--target", action="append", help="slices aimed at; those of the settings' default if none is named")
    publish = commands.add_parser("publish", help="copy a run's results without the paths of this machine")
    publish.add_argument("--to", required=True)
    publish.add_argument("--root", action="append", default=[], metavar="PATH=TAG")
    publish.add_argument("--replace", action="store_true")
    for command in (run, gate, publish):
        command.add_argument("folder", help="the run's folder")
    return top


def _verdict(checks) -> int:
    for row in checks.orderBy("name").collect():  # a few checks
        print(f"{'pass' if row.passed else 'FAIL'}  {row.name}: {row.value} (threshold {row.threshold})")
    promote = decisions.decide(checks).first().promote
    print("promote" if promote else "reject")
    return 0 if promote else 3


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    if args.command == "run":
        tables = runs.Tables(*[spark.read.parquet(getattr(args, name)) for name in ("samples", "gt", *runs.MODELS)])
        print("done now: " + (", ".join(runs.run(tables, args.folder, parsed(args.set), args.until)) or "nothing"))
        return _verdict(artifacts.read_artifact(spark, f"{args.folder}/gate/checks")) if args.until in (None, "gate") else 0
    if args.command == "gate":
        return _verdict(artifacts.gate_again(spark, args.folder + "/gate", args.target or settings()["gate.targets"]))
    print("\n".join(runs.publish(spark, args.folder, args.to, dict(r.rsplit("=", 1) for r in args.root), args.replace)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
