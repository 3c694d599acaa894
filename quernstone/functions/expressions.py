"""Expression trees of UPDATE and DELETE, typed and turned into Spark columns.

Numbers follow the usual precedence.  Integers are computed as 64 bits and
divide towards zero; a FLOAT operand makes the result fractional.  Division by
zero and overflow are errors (ANSI mode).  Text and numbers never compare.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import EngineError
from quernstone.functions.types import is_number

COMPARISONS = ("=", "!=", "<>", "<", ">", "<=", ">=")


@dataclass(frozen=True)
class Literal:
    value: int | float | str | None


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: "Expression"
    right: "Expression"


Expression = Literal | Name | Binary


@dataclass(frozen=True)
class Typed:
    """A column with its kind: ``int``, ``float``, ``text`` or ``bool``; ``None`` for NULL."""

    column: Column
    kind: str | None


def kind_of(type_: T.DataType) -> str:
    if isinstance(type_, T.IntegralType):
        return "int"
    if is_number(type_):
        return "float"
    if isinstance(type_, T.StringType):
        return "text"
    if isinstance(type_, T.BooleanType):
        return "bool"
    return type_.simpleString()


def find_field(schema: T.StructType, name: str) -> T.StructField:
    """A column by name, in any case."""
    found = [f for f in schema if f.name.lower() == name.lower()]
    if len(found) != 1:
        raise EngineError(f"{'ambiguous' if found else 'unknown'} column {name}")
    return found[0]


def typed(e: Expression, schema: T.StructType) -> Typed:
    """The expression over a table's row."""
    if isinstance(e, Literal):
        kind = None if e.value is None else "text" if isinstance(e.value, str) else "int" if isinstance(e.value, int) else "float"
        return Typed(F.lit(e.value), kind)
    if isinstance(e, Name):
        field = find_field(schema, e.column)
        return Typed(F.col(f"`{field.name}`"), kind_of(field.dataType))
    left, right = typed(e.left, schema), typed(e.right, schema)
    if e.op in COMPARISONS:
        return Typed(compare(e.op, left, right), "bool")
    return arithmetic(e.op, left, right)


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    if not {left.kind, right.kind} <= {"int", "float"}:
        raise EngineError(f"{op} needs numbers")
    if left.kind == right.kind == "int":
        a, b = left.column.cast("bigint"), right.column.cast("bigint")
        whole = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.call_function("div", a, b)}
        return Typed(whole[op](), "int")
    a, b = left.column.cast("double"), right.column.cast("double")
    return Typed({"+": a + b, "-": a - b, "*": a * b, "/": a / b}[op], "float")


def compare(op: str, left: Typed, right: Typed) -> Column:
    """A typed comparison; ``= NULL`` asks for absence."""
    if left.kind is None or right.kind is None:
        other = right if left.kind is None else left
        if op == "=":
            return other.column.isNull()
        if op in ("!=", "<>"):
            return other.column.isNotNull()
        raise EngineError("NULL has no order")
    numbers = {"int", "float"}
    if left.kind != right.kind and not {left.kind, right.kind} <= numbers:
        raise EngineError(f"can't compare {left.kind} with {right.kind}")
    a, b = left.column, right.column
    return {"=": a == b, "!=": a != b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
