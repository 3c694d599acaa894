"""A line at a time: ``python -m quernstone.plans.shell ROOT``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from quernstone.errors import EngineError
from quernstone.plans.session import Session

HELP = """Statements end with the line:
  CREATE DATABASE d | USE d | SHOW DATABASES
  CREATE TABLE t (c INT PRIMARY KEY, d VARCHAR, FOREIGN KEY (c) REFERENCES p (k)) | DROP TABLE t | TRUNCATE TABLE t
  INSERT INTO t VALUES (1, "a") | UPDATE t SET c = c + 1 WHERE d = "a" | DELETE FROM t WHERE c > 1
  SELECT c FROM t LEFT JOIN u ON t.c = u.k WHERE d = "a"
  BEGIN | COMMIT | ROLLBACK
  explain SELECT ... | help | exit"""
WIDTH, ROWS = 20, 1000


def render(df: DataFrame, limit: int = ROWS) -> str:
    """Cells of 20 characters, NULL for what is missing; the first ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if not rows:
        return "no rows returned"
    cell = lambda v: ("NULL" if v is None else str(v))[:WIDTH].ljust(WIDTH)
    lines = [" | ".join(map(cell, df.columns)), "-+-".join(["-" * WIDTH] * len(df.columns)), *(" | ".join(map(cell, r)) for r in rows[:limit])]
    return "\n".join([*lines, *(["..."] if len(rows) > limit else [])])


def answer(session: Session, line: str) -> str | None:
    """What to print for a line; None ends the shell."""
    line = line.strip()
    if line.lower() in ("exit", "quit"):
        return None
    if line.lower() in ("help", "?"):
        return HELP
    if not line:
        return ""
    try:
        if line.lower().startswith("explain "):
            return session.sql(line[8:])._jdf.queryExecution().toString()
        return render(session.sql(line))
    except EngineError as e:
        return f"error: {e}"


def main(root: str) -> None:
    session = Session(SparkSession.builder.getOrCreate(), root)
    while True:
        try:
            out = answer(session, input("> "))
        except EOFError:
            return
        if out is None:
            return
        print(out)


if __name__ == "__main__":
    main(sys.argv[1])
