"""Row changes as pure functions from a table's rows to its next rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import EngineError
from quernstone.functions.expressions import Expression, find_field, kind_of, typed
from quernstone.functions.types import stored_value
from quernstone.operators.scans import predicate


def values(spark: SparkSession, schema: T.StructType, rows: list[list]) -> DataFrame:
    """Literal rows, positional and complete."""
    for r in rows:
        if len(r) != len(schema):
            raise EngineError(f"{len(r)} values for {len(schema)} columns")
    return spark.createDataFrame([[stored_value(v, f.dataType) for v, f in zip(r, schema)] for r in rows], schema)


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new)


def _stored(expression: Expression, df: DataFrame, field: T.StructField) -> Column:
    """A value as the column stores it; text for a number is an error, a number for text is spelled out."""
    value = typed(expression, df.schema)
    if value.kind is None:
        raise EngineError("NULL can't be stored")
    target = kind_of(field.dataType)
    if value.kind == "text" and target in ("int", "float"):
        raise EngineError(f"text for {field.dataType.simpleString()} column {field.name}")
    return value.column.cast(field.dataType)


def update(df: DataFrame, changes: dict[str, Expression], condition: Expression | None = None) -> DataFrame:
    """The rows with columns set where the condition holds; every expression sees the old row."""
    fields = {find_field(df.schema, c).name: e for c, e in changes.items()}
    if len(fields) < len(changes):
        raise EngineError("a column is set twice")
    new = {c: _stored(e, df, df.schema[c]) for c, e in fields.items()}
    if condition is not None:
        hit = predicate(df, condition)
        new = {c: F.when(hit, e).otherwise(F.col(f"`{c}`")) for c, e in new.items()}
    return df.withColumns(new)


def matches(df: DataFrame, condition: Expression | None) -> Column:
    """True where a change applies; never NULL."""
    return F.lit(True) if condition is None else F.coalesce(predicate(df, condition), F.lit(False))


def delete(df: DataFrame, condition: Expression | None = None) -> DataFrame:
    """The rows that stay: those for which the condition is false or unknown."""
    return df.where(~matches(df, condition))


def truncate(df: DataFrame) -> DataFrame:
    """No rows, the same schema."""
    return df.limit(0)


def affected(df: DataFrame, condition: Expression | None = None) -> DataFrame:
    """One row: how many rows a change applies to."""
    return df.where(matches(df, condition)).agg(F.count(F.lit(1)).alias("num_affected"))
