"""Command line: python -m loamdex.cli search|sync|retrieve|status|list|watch|mcp|init ..."""

from __future__ import annotations

import argparse
import json
import sys

from loamdex import views


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loamdex")
    out.add_argument("--config")
    sub = out.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--kb")
    s.add_argument("--limit", type=int, default=5)
    for flag in ("fuzzy", "text", "graph", "vector", "local", "exact", "smart", "doc-score", "json"):
        s.add_argument(f"--{flag}", action="store_true")
    s = sub.add_parser("sync")
    s.add_argument("--kb")
    for flag in ("force", "dry-run", "reembed", "json"):
        s.add_argument(f"--{flag}", action="store_true")
    s = sub.add_parser("retrieve")
    s.add_argument("chunk_id", type=int)
    for flag in ("lines-before", "lines-after", "chunks-before", "chunks-after"):
        s.add_argument(f"--{flag}", type=int, default=0)
    s.add_argument("--json", action="store_true")
    for name in ("status", "list", "mcp"):
        s = sub.add_parser(name)
        s.add_argument("--kb")
        s.add_argument("--json", action="store_true")
    s = sub.add_parser("watch")
    s.add_argument("--kb")
    s.add_argument("--interval", type=int)
    for flag in ("once", "daemon", "stop"):
        s.add_argument(f"--{flag}", action="store_true")
    s = sub.add_parser("init")
    s.add_argument("name")
    s.add_argument("paths", nargs="+")
    return out


def chosen_engines(args) -> tuple[str, ...]:
    if args.local:
        return ("local",)
    return tuple(n for n in ("fuzzy", "text", "graph", "vector") if getattr(args, n)) or ("fuzzy", "graph", "vector")


def search(engine, args) -> str:
    engines = chosen_engines(args)
    rows = [r.asDict(True) for r in engine.search(args.query, args.kb, args.limit, engines, args.exact, args.doc_score, args.smart).collect()]
    if args.smart:
        more = {"smart_queries": engine.sub_queries(args.query)}
    else:
        more = {"corrections": [r.asDict() for r in engine.corrections(args.query, args.kb).collect()] if "fuzzy" in engines and not args.exact else []}
    if args.json:
        return json.dumps({"results": rows, **more}, ensure_ascii=False, indent=2)
    shown = views.line_results(rows) if args.exact or engines == ("local",) else views.text_results(rows) if engines in (("text",), ("fuzzy",)) else views.results(rows)
    told = f"Searched for: {', '.join(more['smart_queries'])}" if args.smart else views.corrections(more["corrections"])
    return f"{told}\n{shown}" if told else shown


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from loamdex.sources.config import KnowledgeBase, load_config, render_config

    if args.command == "init":
        print(render_config({args.name: KnowledgeBase(args.paths, True)}), end="")
        return 0
    config = load_config(args.config)
    if args.command == "watch" and (args.daemon or args.stop):
        from loamdex.streaming import daemon

        print(daemon.stop(config.data_dir) if args.stop else daemon.start(config.data_dir, [a for a in (argv if argv is not None else sys.argv[1:]) if a != "--daemon"]))
        return 0
    from pyspark.sql import SparkSession

    from loamdex.engine import Engine

    engine = Engine(SparkSession.builder.appName("loamdex").getOrCreate(), config)
    if args.command == "search":
        print(search(engine, args))
    elif args.command == "watch":
        from loamdex.streaming.watch import watch

        watch(engine, args.kb, args.interval, args.once).awaitTermination()
    elif args.command == "mcp":
        from loamdex.server import serve

        serve(engine)
    else:
        df, show = {
            "sync": lambda: (engine.sync(args.kb, args.force, args.dry_run, args.reembed), views.report),
            "retrieve": lambda: (engine.retrieve(args.chunk_id, args.lines_before, args.lines_after, args.chunks_before, args.chunks_after), lambda rows: "\n".join(map(views.chunk, rows)) or "No such chunk."),
            "status": lambda: (engine.status(args.kb), lambda rows: views.status(rows, config.data_dir)),
            "list": lambda: (engine.list_kbs(), views.bases),
        }[args.command]()
        rows = [r.asDict(True) for r in df.collect()]
        print(json.dumps(rows, ensure_ascii=False, indent=2, default=str) if args.json else show(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
