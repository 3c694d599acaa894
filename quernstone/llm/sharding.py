"""Sharding by sampled splitters.

Main path: DataFrame functions only.  A size-weighted sample of keys gives
quantile boundaries that range-partition the records into many more ranges
than shards.  The exact size of every range is then summed, so the place of
each shard's end is known to the row: the few ranges that a shard's end falls
into are overfull for one shard and subdivided by running sums inside them.

The key is (hash of the text, doc_id): copies lie side by side, and a hot text
is split by id.  Rows equal in id and text can't be told apart by any key; they
are counted into one row before the shuffle and dealt out by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range.
OVERSAMPLE = 32


def _splitters(keyed: DataFrame, fan: int, total: int) -> list[tuple[int, int]]:
    """About ``fan * fan - 1`` boundaries from a size-weighted sample.

    A record is drawn if a hash of its key falls below its share of the bytes,
    so a draw depends on the key alone and the sample holds about
    ``OVERSAMPLE * fan * fan`` keys whatever the input's size.
    """
    wanted = OVERSAMPLE * fan * fan
    chance = F.col("weight").cast("double") * (wanted / max(total, 1))
    coin = F.pmod(F.xxhash64(F.lit(17), "k1", "k2"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sample = sorted((r.k1, r.k2) for r in keyed.where(coin < chance).select("k1", "k2").collect())
    n = fan * fan
    cuts = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    return sorted(set(cuts))


def _range_of(cuts: list[tuple[int, int]], fan: int) -> Column:
    """Number of boundaries at or below the row's key, found in two steps of ``fan``."""
    if not cuts:
        return F.lit(0)
    # Plain literals in SQL text: thousands of Python column objects would be slow to build.
    rows = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    text = lambda k: f"named_struct('a',cast('{k[0]}' as bigint),'b',cast('{k[1]}' as bigint))"
    heads = F.expr("array(" + ",".join(text(r[0]) for r in rows) + ")")
    blocks = F.expr("array(" + ",".join("array(" + ",".join(map(text, r)) + ")" for r in rows) + ")")
    key = F.struct(F.col("k1").alias("a"), F.col("k2").alias("b"))
    first = F.aggregate(heads, F.lit(0), lambda n, x: n + (x <= key).cast("int"))
    return F.when(first == 0, F.lit(0)).otherwise(
        (first - 1) * fan + F.aggregate(blocks[F.greatest(first - 1, F.lit(0))], F.lit(0), lambda n, x: n + (x <= key).cast("int"))
    )


def assign_shards(documents: DataFrame, shards: int = 16, *, range_bytes: int = 64 << 20) -> DataFrame:
    """One row per document row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the UTF-8 bytes of the text (null: none) plus 1.  The law is
    ``bytes``: shard sizes differ by no more than the largest document.
    ``slot`` numbers a shard's rows from 0 without gaps.  Null ids sort first;
    repeated rows get slots of their own; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("k1"),  # 60 bits of a hash that any engine has
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k2"),
    )
    # Partial sums meet before the shuffle, so a row that repeats arrives once from each task.
    same = rows.groupBy("k1", "k2", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("weight", F.col("size") * F.col("copies"))
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    fan = 8
    while fan < 64 and fan * fan * range_bytes < total:
        fan *= 2
    cuts = _splitters(rows.withColumn("weight", F.col("size")), fan, total)
    ranged = same.withColumn("range", _range_of(cuts, fan))

    # Exact totals of every range and what lies before it: at most fan * fan rows.
    sums = ranged.groupBy("range").agg(F.sum("weight").alias("w"), F.sum("copies").alias("c"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))

    inside = Window.partitionBy("range").orderBy("k1", "k2", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("w1", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
        .withColumn("c1", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(F.broadcast(bases), "range")
        .select("doc_id", "size", "text_crc32", (F.col("w0") + F.col("w1")).alias("w"), (F.col("c0") + F.col("c1")).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("j"))
        .withColumn("at", F.col("w") + F.col("j") * F.col("size"))
        .withColumn("order", F.col("c") + F.col("j"))
        # The shard that holds the record's middle byte.
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("at") + F.col("size") / 2) * shards / F.lit(float(max(total, 1))))).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("order").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("order") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Write the documents as ``shard=N`` folders, ordered by slot, in part files of bounded rows.

    Returns the assignment.  Rows of one id and text are interchangeable, so
    they join to their slots by any one of their copies.  Input columns named
    ``shard`` or ``slot`` give way.
    """
    documents = documents.drop("shard", "slot")
    plan = assign_shards(documents, shards)
    slots = plan.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "shard", "slot")
    text = F.coalesce("text", F.lit(""))
    # Copies are numbered on both sides, so that n equal rows meet n slots once each.
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[0]))
    left = documents.withColumn("_crc", F.crc32(F.encode(text, "UTF-8"))).withColumn("_size", (F.octet_length(text) + 1).cast("long")).withColumn("_n", number("doc_id", "_crc", "_size"))
    right = slots.withColumn("_m", number("_id", "_crc", "_size")).withColumnRenamed("_crc", "_crc2").withColumnRenamed("_size", "_size2")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_crc") == F.col("_crc2")) & (F.col("_size") == F.col("_size2")) & (F.col("_n") == F.col("_m"))
    joined = left.join(right, on).drop("_id", "_crc", "_crc2", "_size", "_size2", "_n", "_m")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", 1_000_000).parquet(path)
    return plan
