"""Language identification: held-out accuracy and defined edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import language
from quernstone.llm.shared import ship


def test_held_out_accuracy(spark):
    ship(spark)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.learn_and_identify(df).collect()}
    rows = df.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    asked = [r for r in rows if got[r.doc_id].held_out and r.lang and any(map(str.isalpha, r.text or ""))]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in asked)
    assert len(asked) > 100 and right >= 0.97 * len(asked)
    assert all(0 <= g.score <= 1 for g in got.values())


def test_edges(spark):
    ship(spark)
    rows = [(i, f"the cat and the dog number {i}", "en", 1) for i in range(1, 20)] + [(i, f"der Hund und die Katze nummer {i}", "de", 1) for i in range(20, 40)]
    rows += [(40, None, "en", 1), (41, "", "en", 1), (42, "12 !? 5", "de", 1), (None, "the dog and the cat", None, 1), (43, "und die Katze " * 60_000, None, 1), (43, "und die Katze " * 60_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language.learn_and_identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[40].lang_pred == by[41].lang_pred == by[42].lang_pred == "und" and by[42].score == 0
    assert by[None].lang_pred == "en" and not by[None].held_out and by[43].lang_pred == "de"
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.learn_and_identify(bare).collect()} == {"und"}
    assert language.learn_and_identify(df.limit(0)).collect() == []
    one = language.learn_and_identify(df.where("lang = 'en' OR lang IS NULL"))
    assert {r.lang_pred for r in one.collect()} == {"en", "und"}


def test_margin_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    codes = language.codewords(4)
    model = language.Model(list("abcd"), codes, rng.normal(size=(language.DIMENSIONS, codes.shape[1])).astype(np.float32), np.ones(7), np.ones((4, 7)))
    texts = ["one", "zwei drei", "x" * (language.TOGETHER + 777), "", "fin"]
    together = model.margins(texts)
    for t, m in zip(texts, together):
        assert np.allclose(model.margins([t])[0], m, atol=1e-6)


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 20):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n and (np.abs(code.astype(int).sum(0)) < n).all()


def test_against_a_plain_decoder():
    """Margins, losses and the nearest codeword, bit by bit and gram by gram."""
    import math

    rng = np.random.default_rng(6)
    codes = language.codewords(5)
    bits = codes.shape[1]
    model = language.Model(list("abcde"), codes, rng.normal(size=(language.DIMENSIONS, bits)).astype(np.float32), rng.uniform(0.01, 0.1, bits), rng.uniform(0.1, 1, codes.shape))
    texts = ["The cat", "ein Hund", "Übermut tut", "été", "x", "日本 語"]
    best, score, unsure = model.decode(model.margins(texts))
    for k, text in enumerate(texts):
        raw = b"  " + text.lower().encode() + b"  "
        grams = []
        for i in range(len(raw) - 2):
            two, three = raw[i] << 8 | raw[i + 1], raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
            grams += [(two * 2_654_435_761 & 0xFFFFFFFF) >> 19, ((three * 2_246_822_519 & 0xFFFFFFFF) >> 18) + (1 << 13)]
        margins = [sum(float(model.odds[g, b]) for g in grams) / len(grams) for b in range(bits)]
        losses = [sum(model.weights[c, b] * math.exp(-codes[c, b] * max(-4.0, min(4.0, margins[b] / model.scale[b]))) for b in range(bits)) for c in range(5)]
        order = sorted(range(5), key=lambda c: losses[c])
        if losses[order[1]] - losses[order[0]] > 1e-3 * losses[order[0]]:
            assert best[k] == order[0]
        assert math.isclose(score[k], 1 / sum(math.exp(-2 * (x - min(losses))) for x in losses), rel_tol=1e-2)
        gap = losses[order[1]] - losses[order[0]]
        if abs(gap - 0.25 * losses[order[0]]) > 1e-3:
            assert bool(unsure[k]) == (gap < 0.25 * losses[order[0]])


def test_sample_has_each_text_once(spark):
    ship(spark)
    rows = [(i, "la même phrase se répète ici", "fr") for i in range(3000)] + [(5000 + i, f"one more line number {i} of it", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    drawn = language._sample(df, {"fr": 3000, "en": 300}, 1000).collect()
    assert sum(r.lang == "fr" for r in drawn) == 1 and sum(r.lang == "en" for r in drawn) == 300
    assert 20 < sum(r.judge for r in drawn) < 110
