"""Packing token sequences, shortest pack first over the histogram of lengths.

1. Every text is encoded; whole sequences are cut off its front, the rest is a
   piece of its own.  A piece carries its rank among the pieces of its length
   in its partition, and prefix sums of the counts make that a global rank.
2. The histogram of lengths (at most ``size`` numbers) goes to the driver.
   Lengths are placed longest first into the pack with the most room; packs of
   one pattern are counted, not listed, so the work follows the number of
   patterns and not that of documents.
3. A pattern's slots stand for ranges of ranks of its lengths.  The table of
   these ranges, bounded by the number of lengths, tells each piece by its
   length and rank where it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.shared import written
from quernstone.llm.tokens import encoder


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, times), ...]).

    Longest lengths first; each goes into the packs that are shortest so far,
    if it fits there, else into new ones.
    """
    by_room: list[list] = [[] for _ in range(size + 1)]  # room -> [packs, pattern]
    most = 0  # no pack has more room
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            while most and not by_room[most]:
                most -= 1
            if most < length:
                fit = size // length
                packs, each = (left // fit, fit) if left >= fit else (1, left)
                by_room[size - each * length].append([packs, [(length, each)]])
                most = max(most, size - each * length)
                left -= packs * each
                continue
            packs, pattern = by_room[most].pop()
            used = min(packs, left)
            if used < packs:
                by_room[most].append([packs - used, pattern])
            room = most - length
            same = pattern[-1][0] == length
            new = [*pattern[:-1], (length, pattern[-1][1] + 1)] if same else [*pattern, (length, 1)]
            by_room[room].append([used, new])
            left -= used
    return [(packs, pattern) for room in by_room for packs, pattern in room]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]], first_id: int) -> dict[str, np.ndarray]:
    """Ranges of ranks: ``length, rank, sequence, offset``, sorted by length and first rank.

    The ranks from ``rank`` to the next entry's lie at ``offset`` of the
    sequences from ``sequence`` on.
    """
    rows, used = [], {}
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rank = used.get(length, 0)
                used[length] = rank + packs
                rows.append((length, rank, first_id, offset))
                offset += length
        first_id += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), np.ascontiguousarray(table.T)))


def _pieces(documents: DataFrame, tokenizer: str, end_id: int, size: int, specials_as_text: bool, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer, end_id, specials_as_text)
        ranks = np.zeros(size + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.column(1).slice(at, 512).to_pylist()]
                doc, start, length, crc, total, pieces = [], [], [], [], [], []
                for i, raw in enumerate(encode.many(texts), at):
                    ids = np.frombuffer(raw, encode.dtype).astype("<u4")
                    for a in range(0, len(ids), size):
                        piece = ids[a : a + size]
                        doc.append(i)
                        start.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids))
                        if with_ids:
                            pieces.append(piece.tobytes())
                rank = []
                for n in length:
                    rank.append(ranks[n])
                    ranks[n] += 1
                arrays = [pa.array(np.full(len(doc), part, np.int64)), batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, rank))]
                arrays += [pa.array(pieces, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", *["ids"] * with_ids])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long" + ", ids binary" * with_ids)


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed(documents: DataFrame, tokenizer: str, end_id: int, size: int, specials_as_text: bool, with_ids: bool) -> DataFrame:
    pieces = written(_pieces(documents, tokenizer, end_id, size, specials_as_text, with_ids), "pieces")
    here = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    whole = counts.pop(size, 0)
    table = slots([(whole, [(size, 1)])] * (whole > 0) + pack_histogram(counts, size), 0)
    key = table["length"] << 48 | table["rank"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = here.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank")).alias("rank"), *["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            names = [c.split()[0] for c in PLACED.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][at]), *batch.columns[6:]], names)

    return ranked.mapInArrow(run, PLACED + ", ids binary" * with_ids)


def pack(documents: DataFrame, tokenizer: str, *, end_id: int, size: int = 2048, specials_as_text: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every text (null: empty) is encoded and gets ``end_id``; each id lies in
    exactly one piece of ``size`` ids at most.  Sequences are numbered from 0,
    pieces lie in them without gaps.  Repeated rows, rows that share an id and
    null ids are packed like any other; an empty table gives no rows.
    """
    return _placed(documents, tokenizer, end_id, size, specials_as_text, False)


def padding(length: int, size: int) -> int:
    """Ids that a sequence of ``length`` is padded with: none at a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def sequences(documents: DataFrame, tokenizer: str, *, end_id: int, size: int = 2048, specials_as_text: bool = False) -> DataFrame:
    """The packed sequences: ``sequence_id, ids, doc_ids, starts`` (of each piece in the sequence), without padding.

    A piece carries its ids to its sequence, so repeated rows, rows that share
    an id and null ids are packed like any other.
    """
    placed = _placed(documents, tokenizer, end_id, size, specials_as_text, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [np.frombuffer(b"".join(x), "<i4") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), part.column(2), part.column(3)], ["sequence_id", "ids", "doc_ids", "starts"])

    together = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return together.select("sequence_id", "x.ids", "x.doc_id", "x.offset").mapInArrow(run, "sequence_id long, ids array<int>, doc_ids array<long>, starts array<long>")
