"""``python -m tallyrock COMMAND DUMP ...`` (or by spark-submit): look at and move a dumped database."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans.explain import explain
from .sources import as_inserts, csv_lines
from .sources.sinks import table_text, vertical_text
from .tables import Database


def show(df: DataFrame, form: str) -> None:
    """Rows as a drawn table, vertical, JSON lines or CSV; JSON and CSV stream, a task's rows at a time."""
    out = sys.stdout
    if form in ("table", "vertical"):
        out.write((table_text if form == "table" else vertical_text)(df))
        return
    if form == "json":
        rows = df.toJSON().toLocalIterator()
    else:
        out.write(",".join(df.columns) + "\n")
        rows = (r["line"] for r in csv_lines(df).toLocalIterator())
    for row in rows:
        out.write(f"{row}\n")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyrock", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in {"query": ["sql"], "explain": ["sql"], "tables": [], "export": ["table", "path"], "dump": ["path"], "restore": ["path"]}.items():
        command = commands.add_parser(name)
        command.add_argument("database")
        for x in extra:
            command.add_argument(x)
        if name == "query":
            command.add_argument("--param", action="append", default=[])
            command.add_argument("--format", choices=["table", "vertical", "json", "csv"], default="table")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tallyrock").getOrCreate()
    if given.command == "restore":  # into a new dump, under the constraints
        db = Database(spark)
        print(f"{db.restore(given.path)} rows")
        db.dump(given.database)
        return
    db = Database.stored(spark, given.database)
    if given.command == "query":
        show(db.select(given.sql, given.param), given.format)
    elif given.command == "explain":
        show(explain(db.select(given.sql)), "csv")
    elif given.command == "tables":
        for name in db.in_order():
            print(db.declaration(name).ddl())
    elif given.command == "export":  # one INSERT statement a line, written by all tasks
        as_inserts(db.table(given.table), given.table).write.text(given.path)
    else:
        db.dump(given.path)


if __name__ == "__main__":
    main()
