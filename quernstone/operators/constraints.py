"""Primary-key and foreign-key checks, over changed rows where that is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row, with their number: partial counts, one shuffle of keys."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def existing_keys(new: DataFrame, df: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key the table has."""
    return new.join(df.select(*key), key, "left_semi")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose value the parent lacks; a NULL refers to nothing and is no orphan."""
    keys = parent.select(F.col(f"`{parent_column}`").alias("_parent"))
    return child.where(F.col(f"`{column}`").isNotNull()).join(keys, F.col(f"`{column}`") == F.col("_parent"), "left_anti")
