"""Command line: convert, check, decode, lint, diff, detect; index, stats, status, show, compact; metrics, heatmap, cost, top, recent, export, reset.

Exit codes: 0 done, 1 failed, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time
from contextlib import nullcontext
from dataclasses import replace

from quillet import config
from quillet.functions.detect import EXTENSIONS, detect
from quillet.functions.values import PayloadError, dumps
from quillet.operators import convert


def _read(path: str, most: int | None = None) -> bytes:
    if path == "-":
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read() if most is None else f.read(most + 1)


def _write(path: str | None, data: bytes) -> None:
    """To a file by way of a temporary one beside it, or to standard output."""
    if path is None:
        sys.stdout.buffer.write(data)
        return
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    os.replace(name, path)


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _payload(args) -> int:
    o = config.discover()
    o = replace(o, format_hint=args.hint or EXTENSIONS.get(os.path.splitext(args.input)[1][1:]), **({"target": args.to, "margin_pct": 0.0} if getattr(args, "to", None) else {}))
    data = _read(args.input)
    if args.command == "detect":
        print(detect(data, o.format_hint) or "unknown")
    elif args.command == "check":
        print(json.dumps(convert.inspect(data, o, args.ranks), ensure_ascii=False))
    elif args.command == "diff":
        lines = convert.round_trip_diff(data, o)
        print("\n".join(lines))
        return int(bool(lines))
    elif args.command == "decode":
        _write(args.output, dumps(convert.decode_any(data.decode(), most_bytes=o.max_input_bytes)).encode() + b"\n")
    elif args.command == "lint":
        found = convert.lint(data.decode())
        print("\n".join(found))
        return int(any(x.startswith("error") for x in found))
    else:
        r = convert.convert(data, o)
        _write(args.output, r.text.encode() if r.converted else data)
        print(r.reason or f"saved {r.savings_pct:.1f}%", file=sys.stderr)
    return 0


def _reports(args) -> int:
    from quillet.operators import index, ledger
    from quillet.operators.store import IndexStore
    from quillet.sources import files

    spark = _spark()
    if args.command == "index":
        if os.path.realpath(args.root) in ("/", os.path.expanduser("~")):
            raise PayloadError("not over a root or home folder")
        now = int(time.time())
        store = IndexStore(spark, args.store)
        store.sync(files.index_files(spark, args.root, now, config.discover(args.root), store.read("files"), exclude=args.exclude), now).show()
    elif args.command == "stats":
        store = IndexStore(spark, args.store)
        index.stats(store.read("files"), store.read("conversions"), args.by, args.top, args.type).show(args.top, False)
    elif args.command == "status":
        index.status(IndexStore(spark, args.store).read("files")).show(truncate=False)
    elif args.command == "show":
        store = IndexStore(spark, args.store)
        found = index.show(store.read("files"), store.read("shapes"), store.read("conversions"), args.path)
        if found.isEmpty():
            raise PayloadError(f"{args.path} isn't in the index")
        found.show(truncate=False, vertical=True)
    elif args.command == "compact":
        print(IndexStore(spark, args.store).compact(args.files))
    elif args.command == "reset":
        if not args.yes:
            raise PayloadError("a reset deletes all events; confirm with --yes")
        ledger.reset(spark, args.ledger)
    elif args.command == "export":
        lines = ledger.export(ledger.select(ledger.read(spark, args.ledger), since=args.since, opportunities=True), args.format)
        out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
        with out if args.output else nullcontext():
            for row in lines.toLocalIterator():  # a partition at a time
                out.write(row["line"] + "\n")
    else:
        events = ledger.select(ledger.read(spark, args.ledger))
        today = int(time.time()) // 86400
        if args.command == "heatmap":
            report = ledger.heatmap(events, today - 364, today)
        elif args.command == "cost":
            report = ledger.cost(events)
        elif args.command == "top":
            report = ledger.leaderboard(events, args.by, args.n, args.metric)
        elif args.command == "recent":
            report = ledger.recent(events, args.n)
        else:
            report = ledger.summary(events)
        report.show(max(400, getattr(args, "n", 0)), False)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillet", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("convert", "check", "decode", "lint", "diff", "detect"):
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("--hint")
        p.add_argument("-o", "--output")
        p.add_argument("--ranks")
        if name == "convert":
            p.add_argument("--to", choices=("toon", "onto", "tron"))
    p = commands.add_parser("index")
    p.add_argument("root")
    p.add_argument("--store", required=True)
    p.add_argument("--exclude", action="append", default=[])
    p = commands.add_parser("stats")
    p.add_argument("--store", required=True)
    p.add_argument("--by", choices=("savings", "count", "recency"), default="savings")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--type")
    commands.add_parser("status").add_argument("--store", required=True)
    p = commands.add_parser("show")
    p.add_argument("path")
    p.add_argument("--store", required=True)
    p = commands.add_parser("compact")
    p.add_argument("--store", required=True)
    p.add_argument("--files", type=int, default=1)
    for name in ("metrics", "heatmap", "cost", "top", "recent", "export", "reset"):
        p = commands.add_parser(name)
        p.add_argument("ledger")
        if name in ("top", "recent"):
            p.add_argument("-n", type=int, default=10)
        if name == "top":
            p.add_argument("--by", choices=("source_label", "project_id"), default="source_label")
            p.add_argument("--metric", choices=("bytes", "tokens"), default="bytes")
        if name == "export":
            p.add_argument("--format", choices=("csv", "prometheus", "otel", "json"), default="json")
            p.add_argument("--since", type=int, help="the first day, counted from 1970")
            p.add_argument("-o", "--output")
        if name == "reset":
            p.add_argument("--yes", action="store_true")
    args = parser.parse_args(argv)
    try:
        return _payload(args) if hasattr(args, "input") else _reports(args)
    except (PayloadError, OSError, ValueError) as e:
        print(f"quillet: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
