"""Command line: python -m weft.cli [ingest] DIR | --search QUESTION | --search-file FILE | status | verify | vacuum | sparql QUERY | update UPDATE | load FILE | export FOLDER"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from weft import __version__
from weft.model import Options
from weft.operators.store import Locked
from weft.plans import maintain
from weft.plans.ingest import ingest
from weft.plans.search import search
from weft.plans.shipping import ship_package
from weft.plans.sparql import SparqlError
from weft.sources.walk import DB_DIR

COMMANDS = ("ingest", "status", "verify", "vacuum", "sparql", "update", "load", "export")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weft", description=__doc__)
    p.add_argument("words", nargs="*", help="a command and its argument, or a directory to ingest")
    p.add_argument("--db", default="", help="database folder; else DIR/.weft, else the working directory's")
    p.add_argument("--search", metavar="QUESTION")
    p.add_argument("--search-file", metavar="FILE")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("-k", type=int, default=24)
    p.add_argument("--hops", type=int, default=1)
    p.add_argument("--ctx-budget", type=int, default=8192, help="tokens of sources that the answer may use")
    p.add_argument("--paranoid", action="store_true", help="identity by whole contents")
    p.add_argument("--fix", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--include-superseded", action="store_true")
    p.add_argument("--vector-bits", type=int, default=32, choices=(2, 3, 4, 32), help="bits of a vector's component; the first ingest decides")
    p.add_argument("--threads", type=int, default=0, help="ignored: Spark decides")
    p.add_argument("--gpu", default="", help="ignored")
    p.add_argument("--version", action="version", version=__version__)
    return p


def options_of(args: argparse.Namespace) -> tuple[str, Options]:
    words = list(args.words)
    command = words.pop(0) if words and words[0] in COMMANDS else "search" if args.search or args.search_file else "ingest"
    o = Options(
        include=args.include, exclude=args.exclude, k=args.k, hops=args.hops, ctx_budget=args.ctx_budget, paranoid=args.paranoid, fix=args.fix,
        json=args.json, include_superseded=args.include_superseded,
        vector_bits=args.vector_bits,
    )
    if command in ("sparql", "update", "load", "export"):
        o.query = words.pop(0) if words else sys.stdin.read()
    if command == "search":
        o.query, o.query_file = args.search or "", args.search_file or ""
    if words:
        o.root = os.path.abspath(words[0])
    o.db = args.db or os.path.join(o.root or os.getcwd(), DB_DIR)
    return command, o


def main(argv: list[str] | None = None) -> int:
    command, o = options_of(parser().parse_intermixed_args(argv))
    if command == "ingest" and not o.root:
        parser().print_usage()
        return 2
    spark = SparkSession.builder.appName("weft").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    try:
        if command == "ingest":
            print(json.dumps(ingest(spark, o)))
        elif command == "search":
            found = search(spark, o)
            if o.json:
                print(json.dumps(found, ensure_ascii=False))
            else:
                print(found["answer"] or "No matching content found.")
                for v in found.get("verification", []):
                    print(f"[{v['n']}] {v['path']}: {v['verdict']}")
        elif command == "sparql":
            for line in maintain.graph_query(spark, o).toJSON().toLocalIterator():
                print(line)
        elif command == "update":
            print(json.dumps(maintain.graph_update(spark, o)))
        elif command in ("load", "export"):
            print(json.dumps(getattr(maintain, f"graph_{command}")(spark, o, o.query)))
        else:
            print(json.dumps(getattr(maintain, command)(spark, o), default=str))
    except (Locked, SparqlError, ValueError) as e:
        print(f"weft: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
