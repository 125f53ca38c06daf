"""Running SQL scripts from files or standard input, and results as text tables."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import Any

from tabulon.errors import SqlError
from tabulon.functions.values import render
from tabulon.plans.lexer import statements
from tabulon.session import Engine, Result


def text_table(columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """An aligned table: numbers to the right, NULL where there is no value, and the number of rows."""
    cells = [[render(v) for v in row] for row in rows]
    numeric = [all(row[i] is None or isinstance(row[i], (int, float)) and not isinstance(row[i], bool) for row in rows) for i in range(len(columns))]
    widths = [max([len(c), *(len(row[i]) for row in cells)]) for i, c in enumerate(columns)]
    lines = ["-+-".join(c.ljust(w) for c, w in zip(columns, widths))]
    for row in cells:
        lines.append(" | ".join(v.rjust(w) if n else v.ljust(w) for v, w, n in zip(row, widths, numeric)))
    return "\n".join([*lines, f"({len(rows)} row(s))"]) + "\n"


def shown(result: Result) -> str:
    if result.df is not None:
        return text_table(result.columns, result.rows())
    return (result.message or f"{result.affected} row(s) affected") + "\n"


def run_script(engine: Engine, script: str, out=sys.stdout, stop: bool = True) -> int:
    """Runs a script's statements in one session. Returns how many failed."""
    session, failed = engine.session(), 0
    for sql in statements(script):
        try:
            out.write(shown(session.execute(sql)))
        except SqlError as e:
            failed += 1
            out.write(f"error: {e}\n")
            if stop:
                break
    return failed


def main(argv: Sequence[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = argparse.ArgumentParser(prog="tabulon", description=__doc__)
    args.add_argument("--file", help="script to run; standard input if left out")
    args.add_argument("--mode", default="memory", choices=["memory", "wal", "snapshot"])
    args.add_argument("--data-dir")
    args.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="Parquet files to name as a table")
    given = args.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), given.mode, given.data_dir)
    for pair in given.table:
        name, _, path = pair.partition("=")
        engine.register_parquet(name, path)
    script = open(given.file, encoding="utf-8").read() if given.file else sys.stdin.read()
    return int(run_script(engine, script) > 0)


if __name__ == "__main__":
    sys.exit(main())
