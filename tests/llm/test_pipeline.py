"""The pipeline, stage by stage, against plain versions of the stages."""

import re

import duckdb
import pytest

from quernstone.llm import quality, queries
from quernstone.llm.shared import new_path

from .test_line_runs import brute as brute_lines
from .test_near_dup import brute
from .test_packing import check

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.01"


def stage(spark, k, rows):
    """Rows (doc_id, text) that stage ``k`` keeps of the rows."""
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), D)
    path = new_path(spark, "stage")
    out.write.parquet(path)
    out = spark.read.parquet(path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted((r.doc_id, r.text) for r in out.collect())


def test_stages(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    judged = [(i, quality.judge(t)) for i, t in rows]
    good = stage(spark, 0, rows)
    assert good == sorted((i, j["cleaned"]) for i, j in judged if j["kept"]) and len(good) > 0.5 * len(rows)

    aligned = brute_lines(good)
    lines = stage(spark, 1, good)
    assert lines == sorted((i, aligned[i]) for i, t in good if aligned[i] == t or aligned[i].split())

    classes = brute(lines, 80)
    single = stage(spark, 2, lines)
    assert single == [(i, t) for i, t in lines if classes[i][1] == i]

    clean = stage(spark, 3, single)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{D}/benchmark.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", single)
    hit = dict(con.execute(f"SELECT doc_id, n_hit FROM ({queries.ORACLE_SQL['op8_decontamination']})").fetchall())
    words = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [words(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    grams = {tuple(w[k : k + 13]) for w in items if w for k in range(max(1, len(w) - 12))}
    whole = lambda t: any(tuple(w[k : k + 13]) in grams for w in [words(t)] for k in range(len(w) - 12))
    bad = {i for i, t in single if whole(t) or 20 * hit[i] >= len(words(t)) > 0 < hit[i]}
    assert bad and [i for i, _ in clean] == [i for i, _ in single if i not in bad]
    before = dict(single)
    for i, t in clean:
        assert t == before[i] if not hit[i] else len(words(t)) == len(words(before[i])) - hit[i]

    got = corpus_pipeline.run(spark, D).collect()
    assert check(clean, got, queries.tokenizer_path("word_bpe_49k.json")) < 0.02
