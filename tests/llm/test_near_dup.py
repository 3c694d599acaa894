"""Near duplicates against brute force, and the defined edge cases."""

import re

import pytest

from quernstone.llm import near_dup, setsketch
from quernstone.llm.components import components
from quernstone.llm.shared import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for a in ids:
        shared = {}
        for s in sets[a]:
            for b in where[s]:
                if b > a:
                    shared[b] = shared.get(b, 0) + 1
        for b, c in shared.items():
            if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(df, percent):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, percent=percent).collect()}
    assert got == want
    return want


@pytest.mark.parametrize("percent", [85, 80])
def test_documents_match_brute_force(spark, percent):
    ship(spark)
    want = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), percent)
    assert sum(i != c for i, (_, c) in want.items()) > 20


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 6)
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):  # one chain of gradual change in words and length
        w = base[: 120 - k % 7] + [f"x{k % 11}"]
        w[(3 * k) % 100] = f"y{k % 5}"
        rows.append((k, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 85)


def test_chain_of_weak_candidates_stays_linear(spark, monkeypatch):
    """One cluster of documents that only resemble their neighbours: a few tasks a document, and links found as ever."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 8)
    ship(spark)
    sizes = {}
    for n in (100, 200):
        rows = [(k, " ".join(f"w{i}" for i in range(15 * k, 15 * k + 104))) for k in range(n)]  # similarity 0.74 of neighbours
        rows += [(n + k, rows[k][1] + " end") for k in range(0, n, 25)]  # and some near copies
        df = spark.createDataFrame(rows, "doc_id long, text string")
        marks = near_dup.signatures(df).where("n > 0")
        nodes = near_dup.written(marks.selectExpr("n", "k1", "k2", "doc_id AS id", "sketch"), "nodes")
        clusters = components(near_dup._same_bucket(nodes))
        assert clusters.groupBy("component").count().agg({"count": "max"}).first()[0] > 0.5 * n
        dealt = near_dup._tasks(clusters, nodes, 80).selectExpr("size(tasks) AS k", "block").collect()
        sizes[n] = sum(r.k for r in dealt)
        assert sizes[n] < 42 * n and any(r.block == "" for r in dealt)
    assert sizes[200] < 2.6 * sizes[100]
    want = check(df, 80)
    assert sum(i != c for i, (_, c) in want.items()) == 8


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "one two", "c"), (5, "ONE  two", "d"), (6, long, "e"), (7, long + " end", "f"), (8, "one two", "g"), (8, "one two", "g"), (None, "one two", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 199_996, 6, True), (7, 199_997, 6, False), (8, 1, 4, False), (8, 1, 4, False), (None, 1, None, True)]
    assert got == sorted(want, key=str)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("few", [0, 10, 1 << 20])
def test_components(spark, monkeypatch, few):
    """By rounds alone, by rounds and one task, by one task."""
    from quernstone.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (300, 200), (200, 100), (7, None), (400, 400)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in (100, 101, 200, 300)} | {400: 400}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tied_edges_at_random():
    import numpy as np
    import pyarrow as pa

    from quernstone.llm.components import _tied

    rng = np.random.default_rng(9)
    for n in (2, 30, 400):
        a, b = rng.integers(0, 500, n), rng.integers(0, 500, n)
        root = {int(x): int(x) for x in (*a, *b)}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = sorted((top(x), top(y)))
            root[q] = p
        out = next(_tied(iter([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])])))
        assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == {x: top(x) for x in root}


def test_sketch_estimates_and_merges():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.5, 0.85, 0.95):
        k = round(2000 * 2 * share / (1 + share))
        a, b = x[:2000], x[2000 - k : 4000 - k]
        s, t = setsketch.sketch(a), setsketch.sketch(b)
        guess = setsketch.similarity(np.array([2000]), np.array([len(b)]), np.array([(s > t).sum()]), np.array([(s < t).sum()]))[0]
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(guess - real) < 0.12
        assert (setsketch.merge(s, t) == setsketch.sketch(np.union1d(a, b))).all()
