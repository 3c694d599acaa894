"""Scans, projections and filters; all reach the Parquet scan as column pruning and pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.errors import EngineError
from quernstone.functions.expressions import Binary, Expression, Literal, Name, find_field, kind_of, typed
from quernstone.functions.types import literal_for


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All columns, or the named ones in the given order."""
    if columns is None:
        return df
    return df.select(*[F.col(f"`{find_field(df.schema, c).name}`") for c in columns])


def equal(df: DataFrame, column: str, value: int | float | str | None) -> DataFrame:
    """Rows whose column equals the literal, by the column's type; ``None`` asks for NULL."""
    field = find_field(df.schema, column)
    at = F.col(f"`{field.name}`")
    return df.where(at.isNull() if value is None else at == literal_for(value, field.dataType))


def point_lookup(df: DataFrame, key: str, value: int | float | str) -> DataFrame:
    """The row of a primary key: a pushed equality on files sorted by it."""
    if value is None:
        raise EngineError("a primary key is never NULL")
    return equal(df, key, value)


def range_scan(df: DataFrame, key: str, low: int | float | str, high: int | float | str | None = None) -> DataFrame:
    """Rows with a key from ``low`` on (below ``high``), in key order."""
    field = find_field(df.schema, key)
    at = F.col(f"`{field.name}`")
    found = df.where(at >= literal_for(low, field.dataType))
    return (found if high is None else found.where(at < literal_for(high, field.dataType))).orderBy(at)


def predicate(df: DataFrame, condition: Expression):
    """A condition as a column; a bare value is true where it isn't zero or empty."""
    if isinstance(condition, Binary) and isinstance(condition.left, Name) and isinstance(condition.right, Literal):
        field = find_field(df.schema, condition.left.column)
        value = condition.right.value
        if kind_of(field.dataType) in ("int", "float") and isinstance(value, (int, float)) and condition.op in ("=", "!=", "<>", "<", ">", "<=", ">="):
            at, lit = F.col(f"`{field.name}`"), literal_for(value, field.dataType)
            return {"=": at == lit, "!=": at != lit, "<>": at != lit, "<": at < lit, ">": at > lit, "<=": at <= lit, ">=": at >= lit}[condition.op]
    found = typed(condition, df.schema)
    if found.kind != "bool":
        raise EngineError("WHERE needs a comparison")
    return found.column


def where(df: DataFrame, condition: Expression) -> DataFrame:
    """Rows for which the typed comparison holds."""
    return df.where(predicate(df, condition))
