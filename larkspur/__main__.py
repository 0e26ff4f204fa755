"""Command line: list queries, run one to a file or the terminal, or smoke-test some.

    python -m larkspur list [PREFIX]
    python -m larkspur run NAME --data FOLDER [--out PATH --format parquet|csv|json] [--rows N]
    python -m larkspur smoke --data FOLDER [NAME ...]
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from larkspur import registry

#: What a smoke test runs if no names are given: one query of each kind.
SMOKE = ["canonical_metrics", "a4_model_performance", "j9_aligned_pairs", "w1_retention_curve", "v8_required_fields"]


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="larkspur")
    commands = parser.add_subparsers(dest="command", required=True)
    listing = commands.add_parser("list", help="names of queries")
    listing.add_argument("prefix", nargs="?", default="")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(registry.QUERIES), metavar="name")
    run.add_argument("--out", help="where the result goes; without it rows are shown")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    smoke = commands.add_parser("smoke", help="run some queries and report on each")
    smoke.add_argument("names", nargs="*", default=SMOKE)
    smoke.add_argument("--seconds", type=float, default=60.0, help="a query that takes longer fails")
    for command in (run, smoke):
        command.add_argument("--data", required=True, help="folder of the tables")
    return parser


def smoke(spark: SparkSession, data: str, names: list[str], seconds: float) -> list[tuple[str, str, float]]:
    """Name, outcome and seconds of each query: ok, empty, slow or the error's class."""
    out = []
    for name in names:
        start = time.perf_counter()
        try:
            outcome = "empty" if registry.QUERIES[name](spark, data).isEmpty() else "ok"
        except (PySparkException, KeyError) as error:
            outcome = type(error).__name__
        took = time.perf_counter() - start
        out.append((name, "slow" if outcome == "ok" and took > seconds else outcome, took))
    return out


def main(arguments: list[str] | None = None) -> int:
    options = _parser().parse_args(arguments)
    if options.command == "list":
        print("\n".join(name for name in sorted(registry.QUERIES) if name.startswith(options.prefix)))
        return 0
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    if options.command == "smoke":
        found = smoke(spark, options.data, options.names, options.seconds)
        print("\n".join(f"{outcome:10} {took:8.2f} s  {name}" for name, outcome, took in found))
        return int(any(outcome != "ok" for _, outcome, _ in found))
    df = registry.QUERIES[options.name](spark, options.data)
    if options.out:
        df.write.mode("errorifexists").option("header", "true").format(options.format).save(options.out)
    else:
        df.show(options.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
