"""A session: one open database, at most one transaction.

Statements build DataFrames over immutable snapshots.  A change writes new
folders and stages a manifest; a commit publishes it.  Outside BEGIN every
statement is a transaction of its own, so an error leaves nothing behind.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quernstone.errors import EngineError
from quernstone.functions.expressions import Expression, Name, find_field
from quernstone.operators import constraints, dml, joins, scans
from quernstone.plans import parser
from quernstone.sources.catalog import ColumnDef, ForeignKey, Manifest, Table, define
from quernstone.sources.database import BIG, Database, level, level_of
from quernstone.sources.settings import Settings


def _widened(df: DataFrame) -> DataFrame:
    """FLOAT columns as double."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.FloatType) else F.col(f"`{f.name}`") for f in df.schema])


class Session:
    """``root`` holds the databases.  What isn't given as an argument comes from the Spark session's ``quernstone.*`` settings."""

    def __init__(self, spark: SparkSession, root: str, *, fk_restrict: bool | None = None, most_parts: int | None = None, compact_parts: int | None = None, vacuum_grace_seconds: int | None = None):
        self.spark, self.root = spark, root
        self.settings = Settings.of(spark, fk_restrict=fk_restrict, most_parts=most_parts, compact_parts=compact_parts, vacuum_grace_seconds=vacuum_grace_seconds)
        self._db: Database | None = None
        self._committed = Manifest()
        self._staged: Manifest | None = None

    # ------------------------------------------------------------ databases

    def create_database(self, name: str) -> None:
        Database.create(self.spark, self.root, name)

    def show_databases(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in Database.names(self.spark, self.root)], "name string")

    def use_database(self, name: str) -> None:
        """Open a database in the state of its newest whole commit."""
        if self._staged is not None:
            raise EngineError("a transaction is open")
        db = Database(self.spark, self.root, name)
        if not db.files.exists("logs"):
            raise EngineError(f"no database {name}")
        self._committed, self._db = db.recover(), db

    recover = use_database

    @property
    def database(self) -> Database:
        if self._db is None:
            raise EngineError("no database is in use")
        return self._db

    # --------------------------------------------------------- transactions

    def begin(self) -> None:
        _ = self.database
        if self._staged is not None:
            raise EngineError("a transaction is open")
        self._staged = self._committed

    def commit(self) -> None:
        if self._staged is None:
            raise EngineError("no transaction is open")
        staged, self._staged = self._staged, None
        if staged is not self._committed:
            self._committed = self.database.commit(staged, self._committed)

    def rollback(self) -> None:
        if self._staged is None:
            raise EngineError("no transaction is open")
        self._staged = None

    @property
    def manifest(self) -> Manifest:
        return self._committed if self._staged is None else self._staged

    def _put(self, name: str, table: Table | None) -> None:
        """Stage a table's next state, and commit it where no transaction is open."""
        tables = {n: t for n, t in self.manifest.tables.items() if n != name}
        if table is not None:
            tables[name] = table
        staged = Manifest(self.manifest.version, tables)
        if self._staged is None:
            self._committed = self.database.commit(staged, self._committed)
        else:
            self._staged = staged

    def checkpoint(self) -> None:
        """Gather small parts of tables that have many, and delete what is old and no manifest names."""
        if self._staged is not None:
            raise EngineError("a transaction is open")
        for name, table in list(self._committed.tables.items()):
            small = [p for p in table.parts if level(p) < BIG]
            if len(small) >= self.settings.compact_parts:
                rows = self.database.read(table.with_parts(small))
                gathered = self.database.write(table, rows, level_of(rows.count()))
                self._put(name, table.with_parts([*(p for p in table.parts if p not in small), gathered]))
        self.database.vacuum(grace=self.settings.vacuum_grace_seconds)

    # --------------------------------------------------------------- tables

    def create_table(self, name: str, columns: list[ColumnDef], foreign: list[ForeignKey] | None = None) -> None:
        _ = self.database
        self._put(name, define(self.manifest, name, columns, foreign or []))

    def drop_table(self, name: str) -> None:
        table = self._table(name)
        self._restrict(table, self._rows(table))
        self._put(name, None)

    def _table(self, name: str) -> Table:
        _ = self.database
        return self.manifest.table(name)

    def _rows(self, table: Table, spark: SparkSession | None = None) -> DataFrame:
        return self.database.read(table, spark)

    def table(self, name: str) -> DataFrame:
        """The rows of the current state; FLOAT widened to double."""
        return _widened(self._rows(self._table(name)))

    scan = table

    # -------------------------------------------------------------- queries

    def select(self, query: parser.Select) -> DataFrame:
        table = self._table(query.table)
        rows = self._rows(table)
        if query.join is None:
            names = query.columns or []
            for n in [*names, *([query.where[0]] if query.where else [])]:
                if n.table is not None and n.table.lower() != query.table.lower():
                    raise EngineError(f"unknown table {n.table}")
            if query.where is not None:
                rows = scans.equal(rows, query.where[0].column, query.where[1])
            found = scans.scan(rows, [n.column for n in names] or None)
        else:
            j = query.join
            keys = joins.resolve_keys(j.first, j.second, query.table, j.table)
            found = joins.join(rows, self._rows(self._table(j.table)), *keys, j.how, names=(query.table, j.table))
            if query.where is not None:
                found = joins.where_joined(found, *query.where, query.table)
            if query.columns is not None:
                found = found.select(*[F.col(f"`{joins.joined_column(found, n, query.table)}`") for n in query.columns])
        return _widened(found)

    def _spark_select(self, text: str) -> DataFrame:
        """Spark SQL over the tables as they stand now."""
        try:
            return self._with_views(text)
        except AnalysisException as e:
            raise EngineError(str(e).split("\n")[0]) from None
        except Exception as e:
            if type(e).__name__ == "ParseException":
                raise EngineError(str(e).split("\n")[0]) from None
            raise

    def _with_views(self, text: str) -> DataFrame:
        """In a session of its own, which has the caller's settings and views: the tables' views shadow them there only."""
        used = {w.lower() for w in re.findall(r"\w+", text)}
        sc, caller = self.spark.sparkContext, self.spark._jsparkSession
        own = SparkSession(sc, caller.cloneSession())
        SparkSession(sc, caller)  # rdd.toDF goes by the last session that was made
        for n, table in self.manifest.tables.items():
            if n.lower() in used:
                rows = self._rows(table, own)
                _widened(rows).createOrReplaceTempView(n)
        return own.sql(text)

    # -------------------------------------------------------------- changes

    def insert_rows(self, name: str, rows: list[list]) -> int:
        table = self._table(name)
        self._insert(table, dml.values(self.spark, table.schema, rows), len(rows))
        return len(rows)

    def insert(self, name: str, new: DataFrame) -> int:
        """Many rows at once, by column name."""
        table = self._table(name)
        cast = new.select(*[F.col(f"`{find_field(new.schema, c.name).name}`").cast(table.schema[c.name].dataType).alias(c.name) for c in table.columns])
        missing = F.lit(False)
        for c in table.columns:
            missing = missing | F.col(f"`{c.name}`").isNull()
        part = self.database.write(table, cast)
        rows = self.database.read(table.with_parts([part]))
        if not rows.where(missing).isEmpty():
            raise EngineError("NULL can't be stored")
        n = rows.count()
        if level_of(n) < BIG:  # a part's name tells its size
            part = self.database.renamed(part, level_of(n))
            rows = self.database.read(table.with_parts([part]))
        self._insert(table, rows, n, part)
        return n

    def _insert(self, table: Table, new: DataFrame, n: int, part: str | None = None) -> None:
        if table.key:
            if n > 1 and not constraints.duplicate_keys(new, table.key).isEmpty():
                raise EngineError(f"duplicate key in {table.name}")
            if n == 1:
                row, old = new.first(), self._rows(table)
                for k in table.key:
                    old = scans.equal(old, k, row[k])
                taken = not old.limit(1).isEmpty()
            else:
                taken = not constraints.existing_keys(new, self._rows(table), table.key).limit(1).isEmpty()
            if taken:
                raise EngineError(f"duplicate key in {table.name}")
        self._check_parents(table, new, [f.column for f in table.foreign])
        if n:
            rank, parts = level_of(n), list(table.parts)
            small = [p for p in parts if level(p) < BIG]
            if rank < BIG and len(small) >= self.settings.most_parts:
                # So that single-row inserts don't pile up: the smallest are gathered, a row is rewritten once a level.
                lowest = min(map(level, small))
                least = [p for p in small if level(p) == lowest]
                new = dml.insert(self.database.read(table.with_parts(least)), new)
                part, rank, parts = None, max(rank, min(lowest + 1, BIG)), [p for p in parts if p not in least]
            self._put(table.name, table.with_parts([*parts, part or self.database.write(table, new, rank)]))

    def _check_parents(self, table: Table, rows: DataFrame, columns: list[str]) -> None:
        for f in table.foreign:
            if f.column in columns:
                parent = rows if f.table == table.name else self._rows(self._table(f.table))
                if f.table == table.name:
                    parent = dml.insert(self._rows(table), rows)
                if not constraints.orphans(rows, f.column, parent, f.parent_column).limit(1).isEmpty():
                    raise EngineError(f"{table.name}.{f.column}: no such {f.table}.{f.parent_column}")

    def _restrict(self, table: Table, gone: DataFrame) -> None:
        """With ``fk_restrict``, no child may refer to rows that go."""
        if self.settings.fk_restrict:
            for child in self.manifest.tables.values():
                for f in child.foreign:
                    if f.table == table.name and child.name != table.name:
                        keys = gone.select(F.col(f"`{f.parent_column}`").alias("_gone"))
                        if not self._rows(child).join(keys, F.col(f"`{f.column}`") == F.col("_gone"), "left_semi").limit(1).isEmpty():
                            raise EngineError(f"{child.name}.{f.column} refers to {table.name}")

    def _hit(self, table: Table, condition: Expression | None) -> tuple[int, DataFrame, list[str], int]:
        """How many rows a change applies to, the rows of the files that have one, the other parts, and the level of what is written anew.

        At most one row for each file comes to the driver.
        """
        rows = self._rows(table)
        if not table.parts:
            return 0, rows, [], 0
        place = F.element_at(F.split("_metadata.file_path", "/"), -2), F.element_at(F.split("_metadata.file_path", "/"), -1)
        found = rows.where(dml.matches(rows, condition)).groupBy(F.concat_ws("/", *place).alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
        hit, rest = self.database.split(table, {r["file"] for r in found})
        return sum(r["n"] for r in found), self.database.read(table.with_parts(hit)), rest, max(map(level, hit), default=0)

    def update(self, name: str, changes: dict[str, Expression], condition: Expression | None = None) -> int:
        table = self._table(name)
        rows = self._rows(table)
        dml.update(rows, changes, condition)  # names and types are checked even where no row is hit
        n, hit, rest, rank = self._hit(table, condition)
        if not n:
            return 0
        part = self.database.write(table, dml.update(hit, changes, condition), rank)
        staged = table.with_parts([*rest, part])
        touched = [find_field(rows.schema, c).name for c in changes]
        if set(touched) & set(table.key):
            after = self.database.read(staged)
            if not constraints.duplicate_keys(after, table.key).isEmpty():
                raise EngineError(f"duplicate key in {table.name}")
            if self.settings.fk_restrict:
                self._restrict(table, hit.join(after.select(*table.key), table.key, "left_anti"))
        self._check_parents(staged, self.database.read(table.with_parts([part])), touched)
        self._put(name, staged)
        return n

    def delete(self, name: str, condition: Expression | None = None) -> int:
        table = self._table(name)
        n, hit, rest, rank = self._hit(table, condition)
        if n:
            self._restrict(table, hit.where(dml.matches(hit, condition)))
            left = dml.delete(hit, condition) if condition is not None else hit.limit(0)
            self._put(name, table.with_parts(rest if condition is None or left.isEmpty() else [*rest, self.database.write(table, left, rank)]))
        return n

    def truncate_table(self, name: str) -> int:
        return self.delete(name)

    # ----------------------------------------------------------- statements

    def sql(self, text: str) -> DataFrame:
        """Carry out a statement.  Changes return one row ``num_affected``, others that have no rows one row ``status``."""
        s = parser.parse(text)
        if isinstance(s, parser.Select):
            return self.select(s)
        if isinstance(s, parser.SparkSelect):
            return self._spark_select(s.text)
        if isinstance(s, parser.Simple):
            if s.what == "SHOW DATABASES":
                return self.show_databases()
            {"BEGIN": self.begin, "COMMIT": self.commit, "ROLLBACK": self.rollback}[s.what]()
        elif isinstance(s, parser.OnName):
            if s.what == "TRUNCATE TABLE":
                return self._affected(self.truncate_table(s.name))
            {"CREATE DATABASE": self.create_database, "USE": self.use_database, "DROP TABLE": self.drop_table}[s.what](s.name)
        elif isinstance(s, parser.CreateTable):
            self.create_table(s.name, s.columns, s.foreign)
        elif isinstance(s, parser.Insert):
            return self._affected(self.insert_rows(s.table, [s.values]))
        elif isinstance(s, parser.Update):
            return self._affected(self.update(s.table, s.changes, s.where))
        else:
            return self._affected(self.delete(s.table, s.where))
        return self.spark.createDataFrame([("ok",)], "status string")

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "num_affected long")


__all__ = ["ColumnDef", "ForeignKey", "Name", "Session"]
