"""Sharding by sampled splitters: sizes, slots, copies, edges."""

import zlib
from collections import Counter, defaultdict

import pytest

from quernstone.llm import sharding
from quernstone.llm.shared import new_path, ship


def check(rows, got, shards=16):
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(map(size, (t for _, t in rows)), default=0)
    mean = sum(load.values()) / shards
    assert all(abs(load[s] - mean) <= most + 1 for s in range(shards))


def test_documents(spark):
    ship(spark)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text) for r in df.collect()], sharding.assign_shards(df).collect())


@pytest.mark.parametrize("rows", [[(i, "same text " * 20, 0) for i in range(3000)], [(1, "twin", 0)] * 500 + [(2, None, 0), (3, "", 0), (None, "é", 0)], [(i, "x" * (i % 97), 0) for i in range(2000)] + [(9999, "y" * 30_000, 0)]])
def test_hot_texts_and_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    check([r[:2] for r in rows], sharding.assign_shards(df).collect())


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = sharding.assign_shards(df)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark):
    rows = [(i, f"text {i % 50} " * (i % 9 + 1)) for i in range(400)] + [(7, "twin")] * 5 + [(None, None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, shard int")
    path = new_path(spark, "shards")
    plan = sharding.write_shards(df, path, 4).collect()
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert Counter(r.shard for r in back.collect()) == Counter(r.shard for r in plan)
