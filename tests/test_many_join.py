"""The join for keys that have many rows on both sides."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.operators import joins
from quernstone.plans import catalogue


def tables(spark, left, right):
    x = spark.createDataFrame(left, "k double, a string" if any(isinstance(r[0], float) for r in left) else "k int, a string")
    y = spark.createDataFrame(right, "k double, b long" if any(isinstance(r[0], float) for r in right) else "k long, b long")
    return x, y


@pytest.mark.parametrize(
    "left, right",
    [
        ([(1, "a"), (1, "a"), (1, None), (2, "c"), (None, "d")], [(1, 7), (1, 7), (2, 8), (None, 9), (4, 1)]),
        ([(0.0, "p"), (-0.0, "m"), (float("nan"), "n"), (1.5, "x"), (None, "d")], [(0.0, 1), (-0.0, 2), (float("nan"), 3), (1.0, 4)]),
        ([(i % 3, str(i)) for i in range(2500)], [(float(i % 4) / 2, i) for i in range(20)]),
        ([(1, "a")], []),
    ],
)
def test_same_rows_as_the_plain_join(spark, left, right):
    x, y = tables(spark, left, right)
    plain, many = (joins.join(x, y, "k", "k", names=("x", "y"), many=m) for m in (False, True))
    assert many.schema.simpleString() == plain.schema.simpleString()
    assert Counter(map(str, many.collect())) == Counter(map(str, plain.collect()))


def test_table_with_itself(spark, sf_dir):
    nation = catalogue.external(spark, sf_dir, "nation")
    plain, many = (joins.join(nation, nation, "n_regionkey", "n_regionkey", names=("n", "n"), many=m) for m in (False, True))
    assert many.columns == plain.columns and Counter(many.collect()) == Counter(plain.collect())


def test_rows_are_spread_whatever_the_files_and_keys(spark, tmp_path):
    """One file a table and one hot key: no task makes more than a share of the rows."""
    spark.range(1500).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.when(F.col("id") < 1400, 3).otherwise(F.col("id") % 9).cast("int").alias("s_nationkey"), F.lit(0.5).alias("s_acctbal")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(2000).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.when(F.col("id") < 1900, 3).otherwise(F.col("id") % 9).cast("int").alias("c_nationkey"), F.lit(0.5).alias("c_acctbal"), F.lit("m").alias("c_mktsegment")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    sizes = [r["count"] for r in catalogue.QUERIES["join_many_to_many"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    keys = [Counter(3 if i < hot else i % 9 for i in range(n)) for n, hot in ((1500, 1400), (2000, 1900))]
    assert sum(sizes) == sum(n * keys[1][k] for k, n in keys[0].items())
    assert max(sizes) <= sum(sizes) / 4
