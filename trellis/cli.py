"""Command line: translate, validate, query, materialize, endpoint."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from trellis.engine import Engine
from trellis.errors import TrellisError
from trellis.server import Gateway
from trellis.sources.mapping import load_r2rml


def _engine(args: argparse.Namespace) -> Engine:
    spark = SparkSession.builder.appName("trellis").getOrCreate()
    engine = Engine(spark, node_mode=args.nodes)
    engine.load_mapping_file(args.mapping)
    if args.ontology:
        engine.load_ontology(Path(args.ontology).read_text(encoding="utf-8"))
    if args.data:
        engine.register_parquet(args.data, _tables(spark, args.data))
    return engine


def _tables(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's parquet tables, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trellis", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("translate", "query", "materialize", "endpoint"):
        p = commands.add_parser(name)
        p.add_argument("--mapping", required=True)
        p.add_argument("--ontology")
        p.add_argument("--data", help="folder of parquet tables")
        p.add_argument("--nodes", choices=("key", "iri"), default="iri" if name == "materialize" else "key")
        if name in ("translate", "query"):
            p.add_argument("query")
        if name == "translate":
            p.add_argument("--format", choices=("text", "json", "dot", "mermaid", "plan"), default="plan")
        if name == "materialize":
            p.add_argument("--output", required=True)
            p.add_argument("--format", choices=("ntriples", "parquet"), default="ntriples")
        if name == "endpoint":
            p.add_argument("--port", type=int, default=5820)
            p.add_argument("--workers", type=int, default=4)
    commands.add_parser("validate").add_argument("mapping")
    args = parser.parse_args(argv)
    try:
        if args.command == "validate":
            store = load_r2rml(Path(args.mapping).read_text(encoding="utf-8"))
            print(f"{len(store.maps)} maps, {len(store.all_rules())} rules")
            return 0
        engine = _engine(args)
        if args.command == "translate":
            print(engine.explain(args.query, args.format))
        elif args.command == "query":
            for part in engine.stream_json(args.query):
                print(part, end="")
            print()
        elif args.command == "materialize":
            engine.materialize(args.output, args.format)
        else:
            gateway = Gateway(engine, args.port, args.workers).start()
            print(f"listening on {gateway.port}")
            while True:
                time.sleep(3600)
    except (TrellisError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
