"""Flat token files: unsigned integers plus 64-bit document offsets.

Layout under one folder::

    tokens-00000.bin    ids of the first range of documents, little-endian
    keys-00000.bin      int64: the row keys of its documents, ascending
    offsets-00000.bin   int64: where each document starts in the token file, and the end of the last
    manifest/           Parquet: part, documents, tokens, first and last key, base (prefix sum)

Ids are uint16 where the vocabulary fits and uint32 otherwise.  A document's
place in the whole is ``base`` of its part plus its offset there, so parts are
written independently and only counts meet on the driver.
"""

from __future__ import annotations

import bisect
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import new_path, open_folder
from quernstone.llm.tokens import encoder

#: Bytes of text in a part; more where there would be over ``MOST_PARTS``.
PART_BYTES, MOST_PARTS = 16 << 20, 100_000
#: Numbers read together where files can't be mapped.
TOGETHER = 1 << 20


def _rename(fs: pafs.FileSystem, tmp: str, name: str) -> None:
    """Give a finished file its name; an earlier attempt's equal file gives way."""
    try:
        fs.move(tmp, name)
    except OSError:
        fs.delete_file(name)
        fs.move(tmp, name)


def _put(folder: str, name: str, chunks: list) -> None:
    """Write under a name of its own, then rename: a repeated attempt writes the same bytes."""
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    tmp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as f:
        for c in chunks:
            f.write(c)
    _rename(fs, tmp, f"{root}/{name}")


class Numbers:
    """A file's numbers by place: memory-mapped where it is a local path, else read range by range."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, root = open_folder(folder)
        path, self.dtype = f"{root}/{name}", np.dtype(dtype)
        self.map = self.file = None
        if not isinstance(fs, pafs.LocalFileSystem):
            self.file = fs.open_input_file(path)
        else:
            self.map = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * size, at.start * size), self.dtype)


def _parts(rows: DataFrame) -> int:
    """Parts of about ``PART_BYTES`` of text."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // max(PART_BYTES, -(-total // MOST_PARTS))))


def write_token_files(documents: DataFrame, tokenizer: str, folder: str, *, end_id: int, parts: int | None = None, specials_as_text: bool = False) -> DataFrame:
    """Encode every text (null: empty), append ``end_id``, write in ascending ``doc_id`` order.

    Returns the manifest: ``part, documents, tokens, first_key, last_key, base, dtype``.  Rows that share
    an id are ordered by their text; null ids come first and are stored as the
    smallest int64.  An empty table writes an empty manifest.
    """
    spark = documents.sparkSession
    dtype = encoder(tokenizer, end_id, specials_as_text).dtype.str
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or _parts(rows)
    # The text's hash splits a range in which one id repeats.
    dealt = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer, end_id, specials_as_text)
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        name = f"tokens-{part:05d}.bin"
        tmp = f"{root}/.{name}-{uuid.uuid4().hex}"
        keys, sizes_of, n = [], [], 0
        with fs.open_output_stream(tmp) as f:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                sizes = np.empty(len(ids), np.int64)
                for at in range(0, len(ids), 512):  # bounds the ids held at once
                    for i, got in enumerate(encode.many(batch.column(1).slice(at, 512).to_pylist()), at):
                        sizes[i] = len(got) // encode.dtype.itemsize
                        f.write(got)
                keys.append(ids)
                sizes_of.append(sizes)
                n += int(sizes.sum())
        _rename(fs, tmp, f"{root}/{name}")
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes_of]))
        _put(folder, f"keys-{part:05d}.bin", [key.astype("<i8").tobytes()])
        _put(folder, f"offsets-{part:05d}.bin", [offsets.astype("<i8").tobytes()])
        ends = [int(key[0]), int(key[-1])] if len(key) else [None, None]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, len(key), n, *ends)], ["part", "documents", "tokens", "first_key", "last_key"])

    counts = dealt.mapInArrow(run, "part long, documents long, tokens long, first_key long, last_key long").collect()  # one row a part
    base, manifest = 0, []
    for c in sorted(counts, key=lambda c: c.part):
        manifest.append((*c, base, dtype))
        base += c.tokens
    table = spark.createDataFrame(manifest, "part long, documents long, tokens long, first_key long, last_key long, base long, dtype string")
    table.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32`` from the files alone.

    The crc is that of the ids as little-endian unsigned 32-bit integers.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                tokens, keys, offsets = (Numbers(folder, f"{name}-{m['part']:05d}.bin", kind) for name, kind in (("tokens", m["dtype"]), ("keys", "<i8"), ("offsets", "<i8")))
                for at in range(0, m["documents"], 4096):
                    key = np.array(keys[at : min(at + 4096, m["documents"])])
                    edge = np.array(offsets[at : at + len(key) + 1])
                    crc, k = [], 0
                    while k < len(key):
                        # Documents that are read together: one at least.
                        to = max(k + 1, int(np.searchsorted(edge, edge[k] + TOGETHER, "right")) - 1)
                        ids = tokens[int(edge[k]) : int(edge[to])]
                        crc += [zlib.crc32(np.ascontiguousarray(ids[a:b], "<u4")) for a, b in zip((edge[k:to] - edge[k]).tolist(), (edge[k + 1 : to + 1] - edge[k]).tolist())]
                        k = to
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(edge[:-1] + m["base"]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    found = manifest.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def document_ids(manifest: DataFrame, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document with the key: a search in the keys, then one lookup of its offset."""
    out = []
    for m in manifest.where((F.col("first_key") <= doc_id) & (F.col("last_key") >= doc_id)).orderBy("part").collect():  # one part, or those that a repeated id spans
        tokens, keys, offsets = (Numbers(folder, f"{name}-{m.part:05d}.bin", kind) for name, kind in (("tokens", m.dtype), ("keys", "<i8"), ("offsets", "<i8")))
        at = bisect.bisect_left(range(m.documents), doc_id, key=lambda i: int(keys[i : i + 1][0]))
        while at < m.documents and keys[at : at + 1][0] == doc_id:
            a, b = offsets[at : at + 2].tolist()
            out.append(np.array(tokens[a:b]))
            at += 1
    return out


def token_files(documents: DataFrame, tokenizer: str, *, end_id: int, specials_as_text: bool = False) -> DataFrame:
    """Write to a new folder of the shared directory and read the files back."""
    spark = documents.sparkSession
    folder = new_path(spark, "tokens")
    write_token_files(documents, tokenizer, folder, end_id=end_id, specials_as_text=specials_as_text)
    return read_token_files(spark, folder)
