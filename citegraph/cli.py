"""Command line: ``python -m citegraph.cli lint|stats [folder]``. Exit codes: 0 clean, 1 errors, 2 could not run."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from citegraph.report import NOT_RUN

VERSION = "2.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="citegraph", description="Check and measure a corpus of numbered Markdown documents.")
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("lint", "stats"):
        sub = commands.add_parser(name)
        sub.add_argument("folder", nargs="?", default=".")
        sub.add_argument("--format", choices=("pretty", "json"), default="pretty")
        sub.add_argument("--ignore", action="append", default=[])
        sub.add_argument("--example", action="store_true")
        sub.add_argument("--timeout", type=positive, default=120, help="seconds; then nothing is printed")
        sub.add_argument("--max-memory", type=positive, default=2048, help="MiB of the driver's heap")
    return top


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be above zero")
    return value


def run(args: argparse.Namespace) -> tuple[int, str]:
    """Exit code and report."""
    from pyspark.sql import SparkSession

    from citegraph import report
    from citegraph.plans.validate import validate_corpus
    from citegraph.sources import example, folder

    spark = SparkSession.builder.config("spark.driver.memory", f"{args.max_memory}m").config("spark.ui.enabled", "false").getOrCreate()
    found = None
    if args.example:
        documents = example.example_corpus(spark)
    else:
        found = folder.discover(args.folder, args.ignore, folder.read_ignore(os.getcwd()))
        if found.root_excluded:
            return NOT_RUN, "the ignore file excludes the folder itself"
        if found.unreadable:
            return NOT_RUN, "\n".join(f"cannot read {path}: {reason}" for path, reason in found.unreadable)
        if not found.documents:
            return NOT_RUN, f"no documents in {args.folder}"
        documents = folder.read_documents(spark, found)
    result = validate_corpus(documents)
    if args.command == "stats":
        return 0, report.statistics_json(result) if args.format == "json" else report.statistics_pretty(result)
    text = report.validation_json(result, found) if args.format == "json" else report.validation_pretty(result, found)
    return report.exit_code(result), text


def main(argv: list[str] | None = None) -> int:
    """Runs the command in a child process that is ended at the time limit, so that partial output never shows."""
    argv = sys.argv[1:] if argv is None else argv
    try:
        args = parser().parse_args(argv)
    except SystemExit as end:
        return NOT_RUN if end.code else 0
    if os.environ.get("CITEGRAPH_SUPERVISED"):
        code, text = run(args)
        print(text)
        return code
    try:
        done = subprocess.run([sys.executable, "-m", "citegraph.cli", *argv], env=os.environ | {"CITEGRAPH_SUPERVISED": "1"}, stdout=subprocess.PIPE, timeout=args.timeout, check=False)
    except subprocess.TimeoutExpired:
        print(f"stopped after {args.timeout} seconds", file=sys.stderr)
        return NOT_RUN
    if done.returncode not in (0, 1, 2):
        return NOT_RUN
    sys.stdout.buffer.write(done.stdout)
    return done.returncode


if __name__ == "__main__":
    sys.exit(main())
