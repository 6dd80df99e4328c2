"""python -m querywright.cli check|schema|parse: exit code 0 without errors, 1 with errors, 2 where it cannot run."""

from __future__ import annotations

import argparse
import os
import sys

from querywright.operators.analyze import analyze
from querywright.operators.catalog import build_catalog
from querywright.operators.sinks import capped, clean_sarif, summary, to_json, to_sarif, to_text
from querywright.plans.parser import parse
from querywright.session import session
from querywright.sources.config import Config, find_config, read_config
from querywright.sources.files import expand, read_named, schema_files
from querywright.sources.lexer import SqlError


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="querywright")
    sub = p.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check", help="validate queries against a schema")
    check.add_argument("files", nargs="*")
    check.add_argument("--schema", "-s", action="append", default=[])
    check.add_argument("--schema-dir")
    check.add_argument("--config", "-c")
    check.add_argument("--dialect", "-d")
    check.add_argument("--format", "-f", choices=["human", "json", "sarif"])
    check.add_argument("--disable", action="append", default=[])
    check.add_argument("--max-errors", type=int, default=100)
    check.add_argument("--mode", choices=["strict", "reference"], default="strict")
    check.add_argument("--quiet", "-q", action="store_true")
    schema = sub.add_parser("schema", help="print what schema files declare")
    schema.add_argument("files", nargs="+")
    tree = sub.add_parser("parse", help="print the tree of a query")
    tree.add_argument("query")
    for x in (schema, tree):
        x.add_argument("--dialect", "-d", default="postgresql")
    return p


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def check(a: argparse.Namespace) -> int:
    found = a.config or find_config(".")
    config = (read_config(found) if found else Config()).over(schema=a.schema, files=a.files, dialect=a.dialect, format=a.format, disable=a.disable, schema_dir=a.schema_dir)
    schemas = list(config.schema) + (schema_files(config.schema_dir) if config.schema_dir else [])
    if not schemas:
        raise ValueError("No schema files given. Use --schema, --schema-dir or a configuration file.")
    files = expand(config.files)
    if not files:
        raise ValueError("No query files given.")
    dialect = config.dialect or "postgresql"
    catalog = build_catalog([_read(p) for p in schemas], dialect, a.mode)
    if missing := [p for p in files if not os.path.isfile(p)]:
        raise FileNotFoundError(f"No such file: {missing[0]}")
    for w in catalog.warnings:
        print(f"{w['severity']}[{w['code']}]: {w['message']}\n   = help: {w['help']}\n", file=sys.stderr)
    spark = session(**{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    rows = analyze(read_named(spark, files), catalog, dialect=dialect, mode=a.mode, disable=config.disable).cache()
    shown = capped(rows, a.max_errors)
    match config.format or "human":
        case "json":
            docs = {r["file"]: r["json"] for r in to_json(shown).toLocalIterator()}
            print("\n".join(docs.get(p, f'{{"file":"{p}","diagnostics":[]}}') for p in files))
        case "sarif":
            docs = {r["file"]: r["sarif"] for r in to_sarif(shown).toLocalIterator()}
            for p in files:
                print(docs.get(p) or clean_sarif())
        case _:
            for text in to_text(shown, _read, sys.stderr.isatty()):  # texts of files with findings alone
                print(text, file=sys.stderr)
    total = summary(rows).first()
    if not a.quiet and (config.format or "human") == "human":
        print(f"Found {total['errors']} error(s) in {total['files_with_errors']} of {len(files)} file(s)" if total["errors"] else f"All {len(files)} file(s) passed", file=sys.stderr)
    return int(total["errors"] > 0)


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    try:
        if a.command == "check":
            return check(a)
        if a.command == "schema":
            print(build_catalog([_read(p) for p in a.files], a.dialect).dump())
        else:
            for s in parse(_read(a.query), a.dialect):
                print(s.show())
        return 0
    except (ValueError, OSError, SqlError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
