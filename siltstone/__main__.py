"""Command line: index, sync, search, import, source, eval, config, status, clear, serve."""

from __future__ import annotations

import argparse
import json
import sys

from siltstone.sources.config import load, write_default


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--config")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("index", "status", "clear"):
        sub.add_parser(verb).add_argument("path")
    sub.add_parser("sync").add_argument("path", nargs="?")
    s = sub.add_parser("search")
    for name in ("path", "query"):
        s.add_argument(name)
    s.add_argument("rest", nargs="*", help="limit, types, session in any of the accepted orders")
    i = sub.add_parser("import")
    i.add_argument("what", choices=["knowledge", "memory"])
    i.add_argument("path")
    i.add_argument("--type", default="conversation")
    i.add_argument("--source")
    c = sub.add_parser("source")
    c.add_argument("what", choices=["list", "clear"])
    for name in ("scope_id", "source_type", "source_id", "tool_name", "status"):
        c.add_argument(f"--{name}")
    e = sub.add_parser("eval")
    e.add_argument("path")
    e.add_argument("cases")
    e.add_argument("--limit", type=int, default=0)
    e.add_argument("--types")
    g = sub.add_parser("config")
    g.add_argument("what", choices=["show", "init"])
    g.add_argument("--force", action="store_true")
    sub.add_parser("serve")
    return p


def search_arguments(rest: list[str]) -> tuple[int | None, str | None, str | None]:
    """The third argument is a limit if it is a number, else types; the next is types if every part is known, else a session."""
    from siltstone.operators.search import is_type_list

    rest = list(rest)
    limit = int(rest.pop(0)) if rest and rest[0].lstrip("-").isdigit() else None
    types = rest.pop(0) if rest and is_type_list(rest[0]) else None
    return limit, types, rest.pop(0) if rest else None


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = load(a.config)
    if a.verb == "config":
        if a.what == "init":
            write_default(a.config or f"{config.root}/config.yaml", a.force)
        else:
            print(json.dumps(config.__dict__, default=list, indent=1))
        return 0
    from pyspark.sql import SparkSession

    from siltstone.engine import Engine
    from siltstone.mcp import Server

    spark = SparkSession.builder.master(a.master).appName("siltstone").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    engine = Engine(spark, config.root, config)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if a.verb in ("index", "status"):
        show(getattr(engine, a.verb)(a.path))
    elif a.verb == "clear":
        engine.clear(a.path)
    elif a.verb == "sync":
        show(engine.sync(a.path))
    elif a.verb == "search":
        limit, types, session = search_arguments(a.rest)
        show(engine.search(a.path, a.query, limit=limit, types=types, session=session))
    elif a.verb == "import":
        show(engine.import_knowledge(a.path, a.source) if a.what == "knowledge" else engine.import_memory(a.path, a.type, a.source))
    elif a.verb == "source":
        wanted = {k: getattr(a, k) for k in ("scope_id", "source_type", "source_id", "tool_name", "status")}
        show(engine.clear_sources(**wanted) if a.what == "clear" else [r.asDict(True) for r in engine.sources(**wanted).collect()])
    elif a.verb == "eval":
        cases, summary = engine.evaluate(a.path, a.cases, limit=a.limit, types=a.types)
        show({"cases": [r.asDict(True) for r in cases.collect()], "summary": summary.first().asDict(True)})
    elif a.verb == "serve":
        Server(engine).serve(sys.stdin.buffer, sys.stdout.buffer)
    return 0


if __name__ == "__main__":
    sys.exit(main())
