"""python -m helixflow.cli: list the queries, or run one over a folder of tables and write its result as parquet."""

from __future__ import annotations

import argparse
import sys

from .plans import registry
from .session import session
from .sources.text import write_table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="helixflow")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="where to write parquet; else the first rows are shown")
    run.add_argument("--csv", help="where to write CSV with a header, beside --out")
    args = p.parse_args(argv)
    if args.command == "run" and args.csv and not args.out:
        p.error("--csv goes with --out")
    found = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(found)))
        return 0
    if args.name not in found:
        print(f"no such query: {args.name}", file=sys.stderr)
        return 2
    df = found[args.name](session(), args.folder)
    if args.out:
        write_table(df, args.out, args.csv)
    else:
        df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
