"""The pipeline leaves no benchmark text in the documents that it keeps."""

import corpus_pipeline
from quernstone.llm.shared import new_path


def test_no_passage_stays(spark):
    """A whole window in 2,000 words takes its document; of a shorter item only its words go."""
    item, phrase = " ".join(f"q{i}" for i in range(13)), "three common words"
    filler = " ".join(f"f{i}" for i in range(1000))
    folder = new_path(spark, "benchmark-of-two")
    spark.createDataFrame([(1, item), (2, phrase)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(1, f"{filler} {item} {filler}", "en"), (2, f"a {item} b", "en"), (3, filler, "en"), (4, None, "en"), (5, f"{filler} {phrase} {filler}", "en"), (6, f"{filler} {item.rsplit(' ', 1)[0]} {filler}", "en"), (7, f"so {phrase}", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.decontaminate(spark, docs, folder)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {3: filler, 4: None, 5: f"{filler} {filler}", 6: rows[5][1]}
