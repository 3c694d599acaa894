"""What a manifest holds: tables, columns, keys and the folders of their rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from quernstone.errors import EngineError
from quernstone.functions.types import stored_type


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    parent_column: str


@dataclass(frozen=True)
class Table:
    """``parts``: folders of Parquet files, or single files of one, together the table's rows."""

    name: str
    columns: tuple[ColumnDef, ...]
    foreign: tuple[ForeignKey, ...] = ()
    parts: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, stored_type(c.type), metadata={"pk": True} if c.primary else None) for c in self.columns])

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary]

    def column(self, name: str) -> ColumnDef:
        found = [c for c in self.columns if c.name.lower() == name.lower()]
        if not found:
            raise EngineError(f"unknown column {self.name}.{name}")
        return found[0]

    def with_parts(self, parts: list[str]) -> Table:
        return replace(self, parts=tuple(parts))


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        try:
            return self.tables[name]
        except KeyError:
            raise EngineError(f"no table {name}") from None

    def parts(self) -> set[str]:
        """What all tables are made of."""
        return {p for t in self.tables.values() for p in t.parts}

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "tables": {n: asdict(t) for n, t in self.tables.items()}}, indent=1)

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        tables = {
            n: Table(t["name"], tuple(ColumnDef(**c) for c in t["columns"]), tuple(ForeignKey(**f) for f in t["foreign"]), tuple(t["parts"]))
            for n, t in raw["tables"].items()
        }
        return Manifest(raw["version"], tables)


def define(manifest: Manifest, name: str, columns: list[ColumnDef], foreign: list[ForeignKey]) -> Table:
    """A new table, checked: types known, names distinct, each foreign key to the primary key of an existing table, of one type."""
    if name in manifest.tables:
        raise EngineError(f"table {name} exists")
    if not columns:
        raise EngineError("a table needs a column")
    if len({c.name.lower() for c in columns}) < len(columns):
        raise EngineError("a column is named twice")
    table = Table(name, tuple(replace(c, type=c.type.upper()) for c in columns), tuple(foreign))
    _ = table.schema
    for f in foreign:
        own, parent = table.column(f.column), manifest.table(f.table)
        theirs = parent.column(f.parent_column)
        if not theirs.primary:
            raise EngineError(f"{f.table}.{f.parent_column} is no primary key")
        if theirs.type != own.type:
            raise EngineError(f"{name}.{f.column} is {own.type}, {f.table}.{f.parent_column} is {theirs.type}")
    return table
