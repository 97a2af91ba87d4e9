"""Command line: list and run catalogue queries, and repair a table of sources.

    python -m remedia.cli queries
    python -m remedia.cli run NAME TABLES [--out PATH]
    python -m remedia.cli repair IN OUT [--column source] [--no-deletion] [--no-forced] [--seconds N]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators import rewrite
from .plans import catalogue


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="remedia")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the catalogue's queries")
    run = commands.add_parser("run", help="run one query over a folder of Parquet tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="folder to write Parquet to; without it some rows are shown")
    repair = commands.add_parser("repair", help="repair the sources of a Parquet table")
    repair.add_argument("table")
    repair.add_argument("out")
    repair.add_argument("--column", default="source")
    repair.add_argument("--no-deletion", dest="deletion", action="store_false")
    repair.add_argument("--no-forced", dest="forced", action="store_false")
    repair.add_argument("--seconds", type=float, help="time for one source; what takes longer has stage timed_out")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(arguments)
    if asked.command == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = spark or SparkSession.builder.appName("remedia").getOrCreate()
    if asked.command == "run":
        known = catalogue.queries()
        if asked.name not in known:
            print(f"no query {asked.name}")
            return 2
        rows = known[asked.name](spark, asked.tables)
        rows.write.mode("overwrite").parquet(asked.out) if asked.out else rows.show(truncate=False)
        return 0
    fixed = rewrite.repair(spark.read.parquet(asked.table), asked.column, asked.deletion, asked.forced, seconds=asked.seconds)
    fixed.write.mode("overwrite").parquet(asked.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
