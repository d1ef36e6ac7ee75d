"""Run statements: python -m graphloom [-e TEXT] [-f SCRIPT] [--snapshot FOLDER] [--graph NAME]; without -e and -f they are read from standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from graphloom.language.lexer import split_statements
from graphloom.session import GraphSession


def main(argv: list[str] | None = None) -> int:
    """Print the result of each statement as one line of JSON; the exit code is 1 if any failed."""
    args = argparse.ArgumentParser(prog="graphloom")
    args.add_argument("-e", dest="text")
    args.add_argument("-f", dest="script")
    args.add_argument("--snapshot", help="a snapshot to start from")
    args.add_argument("--graph", help="the graph to use")
    a = args.parse_args(argv)
    session = GraphSession(SparkSession.builder.appName("graphloom").getOrCreate())
    if a.snapshot:
        session.store.restore(a.snapshot)
    if a.graph:
        session.query(f"USE {a.graph}")
    if a.script:
        with open(a.script, encoding="utf-8") as f:
            text = f.read()
    else:
        text = a.text if a.text is not None else sys.stdin.read()
    failed = 0
    for statement in split_statements(text):
        line = session.json(statement)
        failed |= line.startswith('{"status": "error"')
        print(line, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
