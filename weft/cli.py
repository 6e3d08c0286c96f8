"""Command line: scan, search, impact, status, overview, doctor, relay, semantic-search, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from weft.service import Service, serve
from weft.sources import config

COMMANDS = {
    "init": (None, ["path"]), "scan": ("scan_workspace", ["path"]), "search": ("search_entities", ["query"]), "impact": ("analyze_change", ["name"]), "status": ("get_index_status", []),
    "overview": ("show_system_view", []), "doctor": (None, []), "relay": ("build_relay_doc", ["qn"]), "semantic-search": ("semantic_search", ["query"]), "serve": (None, []),
}
OPTIONS = {"limit": int, "offset": int, "depth": int, "operation": str, "view": str}
TAKES = {"search_entities": ("limit", "offset"), "analyze_change": ("limit", "offset", "depth", "operation"), "show_system_view": ("view",), "build_relay_doc": ("depth",), "semantic_search": ("limit",)}


def text_of(data, indent: int = 0) -> str:
    """Plain lines, in the shape of YAML for nested data."""
    pad = "  " * indent
    if isinstance(data, dict):
        return "\n".join(f"{pad}{k}:" + (f" {json.dumps(v, default=str)}" if not isinstance(v, dict | list) or not v else "\n" + text_of(v, indent + 1)) for k, v in data.items())
    if isinstance(data, list):
        return "\n".join(f"{pad}- " + (text_of(v, indent + 1).lstrip() if isinstance(v, dict | list) and v else json.dumps(v, default=str)) for v in data)
    return pad + json.dumps(data, default=str)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weft", description=__doc__)
    p.add_argument("--database", default=".weft", help="folder of the index")
    p.add_argument("--repository", default="default")
    p.add_argument("--format", choices=("json", "text", "yaml"), default="json")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for option, kind in OPTIONS.items():
            c.add_argument(f"--{option}", type=kind)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    tool, names = COMMANDS[args.command]
    if args.command == "init":
        target = f"{args.path.rstrip('/')}/{config.FILE_NAME}"
        with open(target, "x", encoding="utf-8") as file:
            file.write("# settings of the index; see the README\n")
        print(target, file=out)
        return 0
    spark = spark or SparkSession.builder.appName("weft").getOrCreate()
    service = Service(spark, args.database)
    if args.command == "serve":
        serve(service, out=out)
        return 0
    if args.command == "doctor":
        found = {"protocol_version": "1", "status": "ok", "data": {"spark": spark.version, "database": args.database, "indexed": service.warehouse(args.repository).version() is not None}}
    else:
        given = {n: getattr(args, n) for n in names} | {o: getattr(args, o) for o in TAKES.get(tool, ()) if getattr(args, o) is not None}
        found = service.call(tool, given | {"repository": args.repository})
    print(json.dumps(found, default=str) if args.format == "json" else text_of(found["data"] if args.format == "text" and "data" in found else found), file=out)
    return 0 if found["status"] == "ok" else 1


if __name__ == "__main__":
    sys.exit(main())
