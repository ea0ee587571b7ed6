"""Offline tools: python -m kvloom.sources.cli --path BASE --database NAME COMMAND [COLUMN]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from kvloom.functions.ranges import FileRange
from kvloom.sources.store import BINARY_ENTRY, DiskDatabase, LocalSettings

COMMANDS = ("list-column-families", "scan-all", "scan-files", "export-files", "list-files", "dump-all", "verify-checksum")


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines a command prints."""
    names = list(DiskDatabase(spark, LocalSettings(args.path, read_only=True), args.database, {}).manifest(args.version) if args.version is not None else _columns(spark, args))
    if args.command == "list-column-families":
        return sorted(names)
    database = DiskDatabase(spark, LocalSettings(args.path, read_only=True), args.database, {n: BINARY_ENTRY for n in names})
    chosen = [args.column] if args.column else sorted(names)
    if args.command == "list-files":
        return [f for c in chosen for f in database.files(c)]
    if args.command == "dump-all":
        return [database.dump_json()]
    if args.command == "verify-checksum":
        return [json.dumps(r.asDict()) for c in chosen for r in database.verify(c).collect()]
    if args.command == "scan-all":
        return [f"{c}\t{database.verify_files(c).agg({'rows': 'sum'}).first()[0] or 0}" for c in chosen]
    if args.command == "export-files":
        for c in chosen:
            database.export(c, f"{args.out}/{c}")
        return [f"{args.out}/{c}" for c in chosen]
    part = FileRange.parse(args.range)
    return [f"{f}\t{database.read_file(c, f, part).count()}" for c in chosen for f in database.files(c)]


def _columns(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    database = DiskDatabase(spark, LocalSettings(args.path, read_only=True), args.database, {})
    return list(database.manifest(database.head()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--path", required=True)
    p.add_argument("--database", required=True)
    p.add_argument("--version", type=int)
    p.add_argument("--range", default="full", help="none, full, offset-A-B, key-HEX-HEX or single-key-HEX")
    p.add_argument("--out", default="export")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("column", nargs="?")
    return p


if __name__ == "__main__":
    print("\n".join(run(SparkSession.builder.getOrCreate(), parser().parse_args())))
