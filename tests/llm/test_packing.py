"""Packing: every id in one place, little padding, crc as computed plainly."""

import random
import zlib
from collections import defaultdict

import numpy as np

from quernstone.llm import packing
from quernstone.llm.queries import tokenizer_path
from quernstone.llm.shared import ship


def reference(path, end_id):
    """The library's plain call."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end_id]


def check(rows, got, path, size=2048, end_id=1):
    encode = reference(path, end_id)
    want = sorted(((i, len(encode(t))) for i, t in rows), key=str)
    pieces = defaultdict(list)
    for r in got:
        assert 0 < r.length <= size
        pieces[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == list(range(len(pieces)))
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(((r.doc_id, r.doc_tokens) for r in got if r.start == 0), key=str) == want
    assert sum(r.length for r in got) == sum(n for _, n in want)
    ids = {i: encode(t) for i, t in rows}
    if len(ids) == len(rows):
        for r in got:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")) == r.ids_crc32
    return sum(packing.padding(sum(n for _, n in p), size) for p in pieces.values()) / sum(n for _, n in want)


def test_documents(spark):
    ship(spark)
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    got = packing.pack(df, path, end_id=1).collect()
    assert check([(r.doc_id, r.text) for r in df.collect()], got, path) < 0.01


def test_edges(spark):
    ship(spark)
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "one two " * 40_000), (None, "x y"), (5, "é ß <|endoftext|> \0 " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, packing.pack(df, path, end_id=1).collect(), path)
    assert packing.pack(df.limit(0), path, end_id=1).collect() == []


def test_histograms():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.choice([8, 64, 2048])
        counts = {rng.randint(1, size - 1): rng.randint(0, 500) for _ in range(rng.randint(0, size))}
        patterns = packing.pack_histogram(counts, size)
        used = defaultdict(int)
        for packs, pattern in patterns:
            assert packs > 0 and sum(n * k for n, k in pattern) <= size
            for n, k in pattern:
                used[n] += packs * k
        assert used == {n: c for n, c in counts.items() if c}
        table = packing.slots(patterns, 0)
        assert len(table["rank"]) == sum(k for _, p in patterns for _, k in p)


def test_sequences_hold_the_ids(spark):
    ship(spark)
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = df.union(df.where("doc_id < 5")).union(spark.createDataFrame([(None, "x y"), (None, "x y"), (3, "other words")], "doc_id long, text string"))
    encode = reference(path, 1)
    want = sorted(tuple(encode(r.text)[a : a + 2048]) for r in df.collect() for a in range(0, len(encode(r.text)), 2048))
    got = []
    for r in packing.sequences(df, path, end_id=1).collect():
        assert len(r.ids) <= 2048 and r.starts[0] == 0
        got += [(doc, tuple(r.ids[a:b])) for doc, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)])]
    assert sorted(ids for _, ids in got) == want
    assert sum(doc is None for doc, _ in got) == 2 and sum(doc == 3 for doc, _ in got) >= 3
