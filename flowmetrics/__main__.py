"""Command line: list or run catalogue queries.

    python -m flowmetrics list
    python -m flowmetrics run QUERY [--data DIR] [--show N] [--out PATH --format parquet|json]
    python -m flowmetrics explain QUERY [--data DIR]

Runs on the session the environment provides (``spark-submit``) or, when
launched with plain ``python``, on a local session.  Results are written
with the library's sinks, never collected whole to the driver (``--show``
prints at most N rows).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import registry
from .session import apply_defaults, local_session
from .sources.sinks import write_extract, write_json


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_defaults(active)
        return active
    return local_session()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="flowmetrics")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--data", default="/root/testdata/sf0.01", help="folder holding the input tables")
        if name == "run":
            p.add_argument("--show", type=int, default=20, help="rows to print (0 = none)")
            p.add_argument("--out", help="write the full result here")
            p.add_argument("--format", choices=("parquet", "json"), default="parquet")
    args = ap.parse_args(argv)

    qs = registry.queries()
    if args.cmd == "list":
        for name, fn in sorted(qs.items()):
            doc = (fn.__doc__ or "").strip().splitlines()
            print(f"{name:34s} {doc[0] if doc else ''}")
        return 0
    if args.query not in qs:
        print(f"unknown query {args.query!r}; try `python -m flowmetrics list`", file=sys.stderr)
        return 2
    spark = _session()
    df = qs[args.query](spark, args.data)
    if args.cmd == "explain":
        df.explain("formatted")
        return 0
    if args.out:
        (write_json if args.format == "json" else write_extract)(df, args.out)
    if args.show:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
