"""Token files: exact round trip, order, offsets."""

import zlib

import numpy as np

from quernstone.llm import token_files
from quernstone.llm.queries import tokenizer_path
from quernstone.llm.shared import new_path, open_folder, ship

from .test_packing import reference

PATH = tokenizer_path("byte_bpe_50k.json")


def expected(rows):
    encode = reference(PATH, 2)
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        ids = encode(t)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    return out


def test_documents(spark):
    ship(spark)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    got = sorted(map(tuple, token_files.token_files(df, PATH, end_id=2).collect()))
    assert got == expected([(r.doc_id, r.text) for r in df.collect()])


def test_edges_and_layout(spark):
    ship(spark)
    rows = [(5, None, 1), (2, "", 2), (9, "a b\n c  \td", 3), (7, "word " * 60_000, 4), (-4, "é 日本 <|endoftext|> \0", 5), (None, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    folder = new_path(spark, "tokens-test")
    manifest = token_files.write_token_files(df, PATH, folder, end_id=2, parts=3)
    got = token_files.read_token_files(spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected([r[:2] for r in rows])
    parts = sorted(manifest.collect(), key=lambda r: r.part)
    assert [p.base for p in parts] == list(np.cumsum([0, *(p.tokens for p in parts)])[:-1])
    fs, root = open_folder(folder)
    flat = np.concatenate([np.frombuffer(fs.open_input_file(f"{root}/tokens-{p.part:05d}.bin").read(), p.dtype) for p in parts])
    for p in parts:
        keys, offsets = (np.frombuffer(fs.open_input_file(f"{root}/{n}-{p.part:05d}.bin").read(), "<i8") for n in ("keys", "offsets"))
        assert len(offsets) == len(keys) + 1 == p.documents + 1 and offsets[0] == 0 and offsets[-1] == p.tokens and (np.diff(keys) >= 0).all()
    encode = reference(PATH, 2)
    for i, t, _ in rows:
        assert [x.tolist() for x in token_files.document_ids(manifest, folder, -(1 << 63) if i is None else i)] == [encode(t)]
    assert token_files.document_ids(manifest, folder, 6) == []
    assert flat.tolist() == [x for _, t, _ in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]) for x in encode(t)]
    same = token_files.token_files(spark.createDataFrame([(1, "b"), (1, "b"), (1, "a")], "doc_id long, text string"), PATH, end_id=2).collect()
    assert sorted(r.start for r in same) == [0, 2, 4]
    assert token_files.token_files(df.limit(0), PATH, end_id=2).collect() == []


def test_reads_in_ranges(spark, monkeypatch):
    """Small ranges, and files that can't be mapped, give the same rows."""
    ship(spark)
    df = spark.createDataFrame([(k, "word " * (k % 90)) for k in range(500)], "doc_id long, text string")
    folder = new_path(spark, "tokens-ranges")
    manifest = token_files.write_token_files(df, PATH, folder, end_id=2)
    want = expected([(r.doc_id, r.text) for r in df.collect()])
    assert manifest.count() == 1 and sorted(map(tuple, token_files.read_token_files(spark, folder).collect())) == want
    monkeypatch.setattr(token_files.pafs, "LocalFileSystem", type(None))
    numbers = token_files.Numbers(folder, "offsets-00000.bin", "<i8")
    assert numbers.map is None and numbers[3:5].tolist() == [want[3][1], want[4][1]]
    assert len(token_files.document_ids(manifest, folder, 77)[0]) == want[77][2]


def test_special_tokens_in_texts():
    from tokenizers import Tokenizer

    from quernstone.llm.tokens import Encoder

    text = "one <|endoftext|> two"
    plain, encoder = Tokenizer.from_file(PATH), Encoder(PATH, 2, specials_as_text=True)
    assert 50256 in plain.encode(text, add_special_tokens=False).ids
    plain.encode_special_tokens = True
    assert np.frombuffer(encoder(text), encoder.dtype).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_equals_the_library():
    from quernstone.llm.tokens import Encoder

    odd = ["", " ", "a", "A  b", "\n\n a\n b", "x\r\ny", "don't it's", "12,5 a.b", "ǅ İ ﬁ Å", "<|endoftext|>x<|startoftext|>", " a b", "trail ", ".", "word.,", "á é", "日本 語。", "\x1f \x85"]
    for name, end in (("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)):
        path = tokenizer_path(name)
        encode, encoder = reference(path, end), Encoder(path, end)
        texts = odd + [" ".join([x, y, x]) for x in odd for y in odd]
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.many(texts)] == [encode(t) for t in texts]
