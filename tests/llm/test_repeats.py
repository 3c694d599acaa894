"""Exact repeats between documents against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quernstone.llm import repeats
from quernstone.llm.shared import ship
from quernstone.llm.suffix import permuted_prefixes, suffix_array


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - length + 1):
                w = raw[k : k + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - length + 1):
                if first[raw[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **more):
    ship(df.sparkSession)
    return sorted(map(tuple, repeats.remove_repeats(df, **more).collect()), key=str)


def test_documents_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in df.collect()])
    assert sum(w[2] for w in want) > 50_000
    assert run(df, stored=True) == want


@pytest.mark.parametrize("hot", [2, 16_384])
def test_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", 5_000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3_000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(30), text(14)
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", None), (4, "short", "x"), (5, shared, "x"), (5, shared, "x"), (6, shared, "x"), (None, shared, "x"), (7, "z" * 300, "x"), (8, "z" * 120, "x"), (9, "z" * 49, "x")]
    rows += [(k, text(rng.randint(0, 40)) + shared[k % 40 :] + text(5) + other * (k % 3), "y") for k in range(10, 60)]
    rows += [(60, text(30_000), "long"), (61, text(10) + shared[:49] + text(10), "49")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    assert run(df) == brute([r[:2] for r in rows])
    assert run(df.limit(0)) == []
    texts = {r.doc_id: r.text for r in repeats.remove_repeats(df, with_text=True).collect()}
    assert texts[6] == "" and texts[1] is None and texts[9] == "z" * 49 and texts[8] == ""


def test_clear_deletes_what_was_written(spark):
    from quernstone.llm import shared

    table = shared.written(spark.range(3), "numbers")
    assert table.count() == 3
    shared.clear(spark)
    fs, root = shared.open_folder(table._quernstone_path)
    assert fs.get_file_info(root).type.name == "NotFound"


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, k = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        x = rng.integers(0, k, n).astype(np.uint8)
        raw = x.tobytes()
        order = suffix_array(x, k)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        prefixes = permuted_prefixes(x, order, 50)
        for a, b in zip(order, order[1:]):
            common = next((i for i in range(n) if raw[a + i : a + i + 1] != raw[b + i : b + i + 1] or a + i >= n), n)
            assert prefixes[b] == min(common, 50)
