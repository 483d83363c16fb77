"""Commands over the engine: init, build, search, list, status, maintain, skeleton, graph, impact, watch, serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sieveline import config as cfg, server
from sieveline.engine import Engine
from sieveline.errors import EngineError
from sieveline.functions.scalar import preview
from sieveline.streaming.events import event_source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveline", description=__doc__)
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sub.add_parser("build").add_argument("--full", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=5)
    s.add_argument("--prefix")
    s.add_argument("--repo", action="append")
    s.add_argument("--no-tests", action="store_true")
    s.add_argument("--json", action="store_true")
    ls = sub.add_parser("list")
    ls.add_argument("--limit", type=int, default=50)
    ls.add_argument("--prefix")
    ls.add_argument("--by-file", action="store_true")
    sub.add_parser("status")
    sub.add_parser("maintain")
    sk = sub.add_parser("skeleton")
    sk.add_argument("file")
    sk.add_argument("--imports", action="store_true")
    sk.add_argument("--symbol")
    g = sub.add_parser("graph")
    g.add_argument("--kind", choices=["calls", "imports", "inherits", "defines"])
    g.add_argument("--from", dest="source")
    g.add_argument("--to", dest="target")
    g.add_argument("--limit", type=int, default=200)
    i = sub.add_parser("impact")
    i.add_argument("symbol")
    i.add_argument("--depth", type=int, default=2)
    w = sub.add_parser("watch")
    w.add_argument("events", nargs="?", help="folder to which file events are appended as JSON; without one the roots are observed")
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        path = Path(args.root) / cfg.FILE
        if path.exists():
            print(f"{path} exists")
            return 1
        path.write_text('[index]\nexclude = ["dist/", "build/", ".next/", "out/", "tests/"]\n')
        print(f"wrote {path}")
        return 0
    if args.command == "serve":
        server.main()
        return 0
    try:
        engine = Engine(SparkSession.builder.getOrCreate(), args.root)
        return _run(engine, args)
    except (EngineError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(e: Engine, args) -> int:
    if args.command == "build":
        print(json.dumps(e.build(args.full)))
    elif args.command == "search":
        hits = e.search(args.query, args.k, args.prefix, args.repo, not args.no_tests).orderBy("rank").withColumn("preview", preview(F.col("content")))
        for r in hits.collect():
            print(json.dumps(r.asDict()) if args.json else f"{r['path']}:{r['start_line']}-{r['end_line']}  {r['symbol']}  {r['score']:.4f} {r['relevance']}\n    {r['preview']}")
    elif args.command == "list":
        if args.by_file:
            for r in e.chunks_by_path().collect():
                print(f"{r['n_chunks']:6} {r['path']}")
        for r in [] if args.by_file else e.list(args.limit, args.prefix).collect():
            print(f"{r['path']}:{r['start_line']}-{r['end_line']}  {r['symbol']}")
    elif args.command == "status":
        print(json.dumps(e.status(), indent=2))
    elif args.command == "maintain":
        print(json.dumps(e.maintain(), indent=2))
    elif args.command == "skeleton":
        print(e.skeleton(args.file, args.imports, args.symbol))
    elif args.command == "graph":
        edges = e.graph(args.kind, args.source, args.target)
        for r in edges.orderBy("source", "target", "kind").limit(args.limit).collect():
            print(f"{r['source']} -{r['kind']}-> {r['target']}")
        if (more := edges.count() - args.limit) > 0:
            print(f"... {more} more")
    elif args.command == "impact":
        found = e.impact(args.symbol, args.depth)
        for line in (found.warning, found.hint):
            if line:
                print(line)
        for r in found.nodes.orderBy("hop", "id").collect() if found.nodes is not None else []:
            print(f"{r['hop']} {r['kind']:8} {r['file_path']}:{r['start_line']}-{r['end_line']}  {r['qualified_name']}")
    elif args.command == "watch":
        running = e.watch(event_source(e.spark, args.events) if args.events else None)
        try:
            running.wait()
        except KeyboardInterrupt:
            running.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())
