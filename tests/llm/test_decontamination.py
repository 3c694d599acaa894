"""Decontamination: exact windows, spans and edges; the query has its SQL in test_queries."""

from quernstone.llm import decontamination as dc
from quernstone.llm.shared import ship

ITEM = " ".join(f"q{i}" for i in range(20))
SHORT = "only four words here"


def tables(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (10, SHORT), (2, None), (3, ""), (None, "null id words")], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string, n_words string"), bench


def test_spans_and_edges(spark):
    ship(spark)
    filler = " ".join(f"f{i}" for i in range(400))
    docs = [
        (1, None, "x"), (2, "", "x"), (3, f"{filler} {ITEM.upper()} {filler}", "x"), (4, " ".join(ITEM.split()[:12]), "x"), (5, "Only, FOUR -- words\nhere!", None), (5, "Only, FOUR -- words\nhere!", None), (6, filler, "x"), (None, ITEM, "x"),
        (7, f"a {' '.join(ITEM.split()[:13])} b", "x"), (8, (filler + " ") * 300 + ITEM, "x"), (9, f"{SHORT} {SHORT}", "x"),
    ]
    df, bench = tables(spark, docs)
    got = dc.digest(dc.find_hits(df, bench)).collect()
    by = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got}
    assert len(got) == len(docs)
    assert by == {1: (0, 0, 0, False), 2: (0, 0, 0, False), 3: (820, 20, 1, False), 4: (12, 0, 0, False), 5: (4, 4, 1, True), 6: (400, 0, 0, False), None: (20, 20, 1, True), 7: (15, 13, 1, True), 8: (120_020, 20, 1, False), 9: (8, 8, 1, True)}
    shuffled = dc.digest(dc.find_hits(df, bench, max_broadcast_bytes=0)).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8"]
    cut = {r.doc_id: r.text for r in dc.decontaminate(df, bench, remove="spans").collect()}
    assert cut[3].split() == (filler + " " + filler).split() and cut[6] == filler and cut[1] is None and cut[7].split() == ["a", "b"] and cut[5] == "!"
    assert dc.find_hits(df.limit(0), bench).collect() == []
    assert all(r.n_hit == 0 for r in dc.digest(dc.find_hits(df, bench.limit(0))).collect())


def test_main_path_is_native(spark):
    df, bench = tables(spark, [(1, ITEM, "x")])
    plan = dc.digest(dc.find_hits(df, bench))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_thousands_of_separate_runs(spark):
    """Cutting is linear in the text: each of 5,000 passages goes."""
    text = " ".join(f"{SHORT} w{k}" for k in range(5_000))
    df, bench = tables(spark, [(1, text, "x")])
    assert dc.digest(dc.find_hits(df, bench)).first().n_hit == 20_000
    assert dc.decontaminate(df, bench, remove="spans").first().text.split() == [f"w{k}" for k in range(5_000)]
