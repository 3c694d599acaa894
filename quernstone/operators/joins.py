"""Two-table equality joins.

Spark picks the algorithm: broadcast where a side's measured size allows it,
else sort-merge, with skewed partitions split at run time.  Key columns of
different kinds are an error, NULL keys never match.

Where both sides have many rows a key, the work is in the rows that come out,
and neither a side's bytes nor its files tell how many those are.  ``many``
gathers the left rows of a key in blocks, sends each block to every slice of
the key, and deals the right rows out by slices: tasks are even whatever the
keys and files are, and a block is written out in one loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.errors import EngineError
from quernstone.functions.expressions import Name, find_field, kind_of
from quernstone.functions.types import literal_for

#: Rows of a block, as a power of two, and slices of a key.
BLOCK_BITS, SLICES = 10, 32

HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


def _side(name: Name, left: str, right: str) -> str | None:
    """Which side a qualifier names: ``l``, ``r`` or, without one, neither."""
    if name.table is None:
        return None
    found = [s for s, t in (("l", left), ("r", right)) if t.lower() == name.table.lower()]
    if not found:
        raise EngineError(f"unknown table {name.table}")
    return found[0] if len(found) == 1 else None


def resolve_keys(first: Name, second: Name, left: str, right: str) -> tuple[str, str]:
    """The key of each side: by qualifier where there is one, else in the order written."""
    a, b = _side(first, left, right), _side(second, left, right)
    if a is not None and a == b:
        raise EngineError("a join key of each table is needed")
    return (second.column, first.column) if a == "r" or b == "l" else (first.column, second.column)


def _blocks(df: DataFrame, key: str) -> DataFrame:
    """The rows of each key in arrays of bounded length; they are numbered in the order of all columns, so a repeated task makes equal blocks."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    at = F.col(f"`{key}`")
    number = F.row_number().over(Window.partitionBy(at).orderBy(*cols))
    numbered = df.where(at.isNotNull()).select(at.alias("_key"), F.shiftright(number - 1, BLOCK_BITS).alias("_block"), F.struct(*cols).alias("_rows"))
    return numbered.groupBy("_key", "_block").agg(F.collect_list("_rows").alias("_rows")).drop("_block")


def _join_many(x: DataFrame, y: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join: a row of ``y`` is in one slice by a hash of its columns, a block of ``x`` in all slices of its key."""
    spark = x.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    key = F.col(f"`{right_key}`")
    kind = x.select(F.col(f"`{left_key}`")).union(y.select(key)).schema[0].dataType  # both keys are dealt by one type
    blocks = _blocks(x, left_key).select(F.col("_key").cast(kind).alias("_key"), "_rows", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("_slice"))
    rows = y.where(key.isNotNull()).select("*", key.cast(kind).alias("_at"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in y.columns]), F.lit(SLICES)).cast("int").alias("_part"))
    met = rows.repartition(tasks, "_at", "_part").join(blocks.repartition(tasks, "_key", "_slice").hint("merge"), (F.col("_at") == F.col("_key")) & (F.col("_part") == F.col("_slice")))
    theirs = [F.col(f"`{c}`") for c in y.columns]
    return met.select(*theirs, F.inline("_rows")).select(*[F.col(f"`{c}`") for c in x.columns], *theirs)


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "INNER", *, names: tuple[str, str] = ("l", "r"), separator: str = ".", many: bool = False) -> DataFrame:
    """Join on equality; columns are named ``table.column`` in the order left, right.

    A table joined with itself takes the name ``table_2`` on its right side.
    ``many`` is for inner joins by keys that have many rows on both sides; the smaller table goes left.
    """
    if how.upper() not in HOW:
        raise EngineError(f"unknown join {how}")
    a, b = names
    b = f"{a}_2" if a.lower() == b.lower() else b
    lk, rk = find_field(left.schema, left_key), find_field(right.schema, right_key)
    kinds = {kind_of(lk.dataType), kind_of(rk.dataType)}
    if len(kinds) > 1 and not kinds <= {"int", "float"}:
        raise EngineError(f"can't join {lk.dataType.simpleString()} with {rk.dataType.simpleString()}")
    x = left.select(*[F.col(f"`{c}`").alias(f"{a}{separator}{c}") for c in left.columns])
    y = right.select(*[F.col(f"`{c}`").alias(f"{b}{separator}{c}") for c in right.columns])
    if many and how.upper() == "INNER":
        return _join_many(x, y, f"{a}{separator}{lk.name}", f"{b}{separator}{rk.name}")
    return x.join(y, F.col(f"`{a}{separator}{lk.name}`") == F.col(f"`{b}{separator}{rk.name}`"), HOW[how.upper()])


def joined_column(df: DataFrame, name: Name, left: str, separator: str = ".") -> str:
    """A joined column by qualified name; an unqualified one belongs to the left table, or else to the right."""
    if name.table is not None:
        return find_field(df.schema, f"{name.table}{separator}{name.column}").name
    wanted = f"{left}{separator}{name.column}".lower()
    found = [c for c in df.columns if c.lower() == wanted] or [c for c in df.columns if c.lower().endswith(f"{separator}{name.column}".lower())]
    if not found:
        raise EngineError(f"unknown column {name.column}")
    return found[0]


def where_joined(df: DataFrame, name: Name, value: int | float | str | None, left: str, separator: str = ".") -> DataFrame:
    """Filter after a join.  ``= NULL`` keeps the rows padded on that side; Catalyst turns other filters into pushed ones and outer joins into inner ones."""
    column = joined_column(df, name, left, separator)
    at = F.col(f"`{column}`")
    return df.where(at.isNull() if value is None else at == literal_for(value, df.schema[column].dataType))
