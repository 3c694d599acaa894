"""The three storable types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import EngineError

STORED: dict[str, T.DataType] = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "VARCHAR": T.StringType()}


def stored_type(name: str) -> T.DataType:
    """The Spark type of a declared one; an unknown name is an error when the table is made."""
    try:
        return STORED[name.upper()]
    except KeyError:
        raise EngineError(f"unknown type {name}: use INT, FLOAT or VARCHAR") from None


def stored_value(value: int | float | str, kind: T.DataType) -> int | float | str:
    """A literal as its column stores it: anything as text for VARCHAR, numbers and text that spells one for numeric columns.

    INT takes whole numbers only: what would lose a fractional part is an error.
    """
    if value is None:
        raise EngineError("NULL can't be stored")
    try:
        if isinstance(kind, T.IntegerType):
            if isinstance(value, str) and not re.fullmatch(r"\s*[+-]?[0-9]+\s*", value) or isinstance(value, float) and not value.is_integer():
                raise EngineError(f"{value!r} is no whole number")
            got = int(value)
            if not -(1 << 31) <= got < 1 << 31:
                raise EngineError(f"{value} doesn't fit INT")
            return got
        if isinstance(kind, T.FloatType):
            return float(value)
    except (ValueError, OverflowError):
        raise EngineError(f"{value!r} is no {kind.simpleString()}") from None
    return str(value)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def literal_for(value: int | float | str, kind: T.DataType) -> Column:
    """A literal to compare with a column of the type.

    Text is read as the column's type, and must be readable.  An integral
    literal keeps an integral column's own width, so the filter reaches the
    Parquet scan; FLOAT columns compare as float.
    """
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    if not is_number(kind):
        return F.lit(value).cast(kind)
    if isinstance(value, str):
        try:
            value = float(value) if any(c in value for c in ".eE") else int(value)
        except ValueError:
            raise EngineError(f"{value!r} is no {kind.simpleString()}") from None
    if isinstance(kind, T.IntegralType) and isinstance(value, int):
        bits = {"tinyint": 8, "smallint": 16, "int": 32}.get(kind.simpleString(), 64)
        return F.lit(value).cast(kind) if -(1 << bits - 1) <= value < 1 << bits - 1 else F.lit(value)
    return F.lit(float(value)).cast(kind) if isinstance(kind, T.FractionalType) else F.lit(value)
