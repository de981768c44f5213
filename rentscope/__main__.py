"""Run a registered report from the command line.

    python -m rentscope list
    python -m rentscope run NAME SF_DIR [--out PATH] [--format parquet|json] [--show N]

``run`` writes the whole result with Spark (``--out``) or prints the first
``--show`` rows; nothing else is gathered on the driver.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rentscope")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="names of the registered reports")
    run = sub.add_parser("run", help="run one report")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--format", choices=("parquet", "json"), default="parquet")
    run.add_argument("--show", type=int, default=20)
    args = parser.parse_args(argv)

    from rentscope.registry import ORACLE, QUERIES

    if args.cmd == "list":
        for name in QUERIES:
            print(f"{name}{'' if name in ORACLE else '  (model)'}")
        return 0

    if args.name not in QUERIES:
        parser.error(f"unknown report {args.name!r}; see `python -m rentscope list`")
    from pyspark.sql import SparkSession

    from rentscope.session import configure
    from rentscope.sources import sinks

    # Started without the web UI (it would open a server port).
    builder = SparkSession.builder.appName(f"rentscope-{args.name}").config("spark.ui.enabled", "false")
    spark = configure(builder.getOrCreate())
    df = QUERIES[args.name](spark, args.sf_dir)
    if args.out:
        (sinks.write_json if args.format == "json" else sinks.write_parquet)(df, args.out)
        print(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
