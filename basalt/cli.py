"""The interactive shell: python -m basalt.cli [--warehouse DIR] [--log DIR]"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from basalt.operators.engine import Engine, ExecutionResult
from basalt.operators.wal import WriteAheadLog, recovered
from basalt.plans.syntax import CreateIndex, CreateTable, Insert, SyntaxProblem, parse, tokenize

HELP = r"""Commands:
  \help, \h, \?        this text
  \tables              tables and their number of columns
  \desc TABLE          columns and indexes of a table
  \quit, \exit, \q     leave

SQL: CREATE TABLE, CREATE INDEX, INSERT, SELECT. A statement ends with a semicolon."""
SHOWN = 50


class Shell:
    """Reads lines, runs each statement in a transaction of its own and prints what came of it."""

    def __init__(self, engine: Engine, out=sys.stdout):
        self.engine, self.out = engine, out
        self.kept: list[str] = []

    def say(self, text: str = "") -> None:
        print(text, file=self.out)

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            if not self.line(line.rstrip("\n")):
                return

    def line(self, line: str) -> bool:
        """Take a line; False when the shell should end. Lines are joined as lines, so a comment ends
        with its line."""
        if not self.kept and line.strip().startswith("\\"):
            return self.command(line.strip()[1:])
        if not self.kept and not line.strip():
            return True
        self.kept.append(line)
        text = "\n".join(self.kept)
        tokens = tokenize(text)
        if len(tokens) > 1 and tokens[-2].kind == ";":
            self.kept = []
            self.statement(text)
        return True

    def command(self, text: str) -> bool:
        word, _, rest = text.partition(" ")
        if word in ("quit", "exit", "q"):
            return False
        if word in ("help", "h", "?"):
            self.say(HELP)
        elif word == "tables":
            names = self.engine.catalog.list_tables()
            for name in names:
                n = len(self.engine.catalog.get_table(name).to_schema())
                self.say(f"  {name} ({n} column{'s' * (n != 1)})")
            if not names:
                self.say("No tables found.")
        elif word == "desc":
            self.describe(rest.strip())
        else:
            self.say(f"Unknown command: \\{word}\nType \\help for help.")
        return True

    def describe(self, name: str) -> None:
        table = self.engine.catalog.get_table(name)
        if table is None:
            self.say(f"Table '{name}' not found.")
            return
        for r in self.engine.catalog.describe(name).orderBy("position").collect():
            self.say(f"  {r.column_name:<20}{r.data_type:<15}{'YES' if r.nullable else 'NO'}")
        for index in table.indexes:
            self.say(f"  index {index.name} on column {table.position(index.column)}")

    def statement(self, text: str) -> None:
        start = time.monotonic()
        txn = self.engine.begin()
        try:
            statement = parse(text)
            result = self.engine.execute(statement, txn)
            self.show(statement, result)
            if result.success:
                self.engine.commit(txn)
        except SyntaxProblem as problem:
            self.say(f"Error: {problem}")
        finally:
            if txn.active:
                self.engine.abort(txn)
        self.say(f"({(time.monotonic() - start) * 1000:.0f} ms)")

    def show(self, statement, result: ExecutionResult) -> None:
        if not result.success:
            self.say(f"Error: {result.text}")
        elif isinstance(statement, (CreateTable, CreateIndex)):
            self.say(f"{'Table' if isinstance(statement, CreateTable) else 'Index'} created.")
        elif isinstance(statement, Insert):
            self.say("1 row inserted.")
        else:
            rows = result.frame.limit(SHOWN + 1).collect()
            self.say(" | ".join(result.frame.columns))
            for row in rows[:SHOWN]:
                self.say(" | ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in row))
            n = len(rows) if len(rows) <= SHOWN else result.rows_affected
            self.say(f"{n} row{'s' * (n != 1)} returned.")


def main(args: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(prog="basalt", description="Interactive SQL shell.")
    options.add_argument("--warehouse", default="basalt-warehouse", help="folder of the tables")
    options.add_argument("--log", default=None, help="folder of the write-ahead log")
    chosen = options.parse_args(args)
    spark = SparkSession.builder.appName("basalt").getOrCreate()
    log = WriteAheadLog(spark, chosen.log or f"{chosen.warehouse}/_log")
    if log.next_lsn > 1:
        print(f"Recovered {recovered(log.frame()).count()} pages from the log.")
    engine = Engine(spark, chosen.warehouse, log)
    try:
        Shell(engine).run(sys.stdin)
    finally:
        engine.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
