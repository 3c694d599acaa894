"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  Its result is written as Parquet in the shared folder and read again,
so a lost executor costs one stage at most.  All stages but the last return
the columns of documents.

Line dedup, which cuts passages, comes before the search for near copies, which
takes or leaves whole documents: what an edited copy shares with its original
goes line by line, and the later stage finds copies that no run of lines gives
away, such as those with a word changed in every line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import decontamination, line_dedup, near_dup, packing, quality
from quernstone.llm.queries import tokenizer_path
from quernstone.llm.shared import new_path, ship

SEQUENCE = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines removed; documents that fail as a whole or lose too much go."""
    ship(spark)
    return quality.clean(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that any earlier document has are removed; documents left without words go."""
    ship(spark)
    return line_dedup.without_common_lines(docs)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return near_dup.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of 13 benchmark words go, and those that are benchmark text to one word in 20; shorter items are cut out of the others."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="both", any_window=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence."""
    ship(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, size=SEQUENCE)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", deduplicate_lines),
    ("near-duplicates", deduplicate_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Lines are aligned and near copies are tied together step by step; SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
