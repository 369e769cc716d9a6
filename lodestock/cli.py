"""The command line: init, add, summary, demo."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from lodestock.catalog import Catalog
from lodestock.functions.expr import ADDED, ALREADY_PRESENT

# The fixed lines of `demo`.
DEMO_LINES = ("视觉数据集工作台", "本地 CPU 模式：可用", "当前数据集摘要：")


def _summary_line(catalog: Catalog) -> str:
    return json.dumps(catalog.summary(), ensure_ascii=False, sort_keys=True)


def _init(args: argparse.Namespace) -> list[str]:
    catalog = Catalog(args.workspace)
    catalog.initialize()
    return [f"Initialized dataset workspace: {catalog.root}"]


def _add(args: argparse.Namespace) -> list[str]:
    catalog = Catalog(args.workspace)
    if len(args.source) == 1:
        outcomes = [catalog.add(args.source[0], args.label)]
    else:
        outcomes = catalog.add_many([(s, args.label) for s in args.source])
    return [f"{ADDED if o.added else ALREADY_PRESENT}: {o.digest}" for o in outcomes]


def _summary(args: argparse.Namespace) -> list[str]:
    return [_summary_line(Catalog(args.workspace))]


def _demo(args: argparse.Namespace) -> list[str]:
    """Shows the summary of a workspace, and creates nothing where there is none."""
    catalog = Catalog(args.workspace)
    empty = {"bytes": 0, "items": 0, "labels": {}}
    last = _summary_line(catalog) if catalog.manifest_path.exists() else json.dumps(empty)
    return [*DEMO_LINES, last]


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestock")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, text: str) -> argparse.ArgumentParser:
        own = sub.add_parser(name, help=text)
        own.set_defaults(run=run)
        return own

    command("init", _init, "create a workspace").add_argument("workspace", type=Path)
    add = command("add", _add, "import files")
    add.add_argument("workspace", type=Path)
    add.add_argument("source", type=Path, nargs="+")
    add.add_argument("--label")
    command("summary", _summary, "print the workspace's summary").add_argument("workspace", type=Path)
    command("demo", _demo, "show a summary without writing").add_argument("--workspace", type=Path, default=Path("."))
    return top


def main(argv: list[str] | None = None) -> int:
    """0 when done, 1 with a message on an error, 2 for wrong usage."""
    args = arguments().parse_args(argv)
    try:
        lines = args.run(args)
    except (OSError, ValueError) as fault:
        print(f"lodestock: {type(fault).__name__}: {fault}", file=sys.stderr)
        return 1
    print("\n".join(lines))
    return 0
