"""Exact repeats between documents by suffix arrays of content-defined shards.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Texts are never shuffled; four passes read them:

1. ``_identities``: equal texts.  A copy of a text with a smaller id is decided
   at once and left out of the rest.
2. ``_anchors``: of every window of ``length`` bytes the gram with the smallest
   hash.  Equal windows have equal anchors, so only anchors that two documents
   have can matter.  A chunk of texts sends each different anchor once: 48 bits
   of hash, 16 of rank, and a byte for how often it occurs there.
3. ``_segments``: around each anchor that recurs, the bytes of all windows that
   it stands for.  They are dealt by anchor, so equal windows meet in one
   shard.  A shard's suffix array is built by induced sorting; where the
   permuted common prefixes reach ``length`` windows are equal, and each gets
   the smallest id that has it.
4. ``_results``: removed runs are cut out of the texts.

An anchor with more than ``HOT`` occurrences would make a shard that grows with
the corpus.  Its windows are dealt in small blocks instead, each once for a
document, by their bytes, and their smallest ids meet in partial aggregates;
the windows of blocks that no smaller id has are dealt one by one.

Passes find their rows again by place: the number of the scan's partition and
of the row in it.  The operator holds the splits fixed while it runs, and every
pass checks that each partition has the rows and bytes that the first one saw.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shared import delete, dropped, lean_worker, new_path, open_folder, written
from quernstone.llm.shingles import ODD, mix
from quernstone.llm.suffix import permuted_prefixes, suffix_array

GRAM = 24
#: Bytes of text whose anchors travel together, and the most that these grow to so that there are no more than ``MOST_CHUNKS``:
#: an anchor that all chunks have brings nine bytes from each to its bucket.
CHUNK, LARGEST_CHUNK, MOST_CHUNKS = 512 << 10, 8 << 20, 1 << 24
#: Occurrences of an anchor, about, from which its windows are dealt one by one: their segments would be a third of a shard.
HOT = 16_384
#: Bytes of anchors in a bucket, and of segments in a shard, aimed at.
BUCKET_BYTES, SHARD_BYTES = 3 << 20, 4 << 20
#: Folders by which a pass finds what an earlier one has for its partition; beyond it they hold several partitions, sorted.
MOST_FOLDERS = 4096


def _words_at(raw: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Eight bytes from each position, as integers."""
    return np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))[at]


class Chunk:
    """Texts side by side, and the anchors of their windows."""

    def __init__(self, rows: list[int], ids: list[int], texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.rows, self.ids = np.array(rows, np.int64), np.array(ids, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.ends = self.starts + sizes
        self.raw = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
        n = int(sizes.sum())
        self.length = length
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.spot = empty
        self.key = np.zeros(0, np.uint64)
        if n < length:
            return
        w = length - GRAM + 1
        h = _words_at(self.raw, slice(0, n)) * ODD[0]
        h ^= _words_at(self.raw, slice(8, n + 8)) * ODD[1]
        h ^= h >> np.uint64(29)
        h += _words_at(self.raw, slice(GRAM - 8, n + GRAM - 8)) * ODD[2]
        h ^= h >> np.uint64(32)
        h *= ODD[3]
        v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # of equal hashes the leftmost
        span = 1
        while span * 2 <= w:
            v = np.minimum(v[: len(v) - span], v[span:])
            span *= 2
        if span < w:
            v = np.minimum(v[: len(v) - (w - span)], v[w - span :])
        spot = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
        inside = np.zeros(n + 1, np.int32)
        long = sizes >= length
        np.add.at(inside, self.starts[long], 1)
        np.add.at(inside, self.ends[long] - length + 1, -1)
        valid = np.flatnonzero(np.cumsum(inside[: len(spot)]) > 0)
        spot = spot[valid]
        new = np.flatnonzero((spot[1:] != spot[:-1]) | (np.diff(valid) > 1)) + 1
        self.first = valid[np.concatenate(([0], new))] if len(valid) else empty
        self.last = valid[np.append(new - 1, len(valid) - 1)] if len(valid) else empty
        at = spot[np.concatenate(([0], new))] if len(valid) else empty
        self.spot, self.key = at, mix(h[at])

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _read(folder: str, part: int) -> pa.Table | None:
    """What an earlier pass wrote for a partition of the scan."""
    fs, root = open_folder(folder)
    from pyarrow.fs import FileSelector

    step = int(folder.rsplit("-by-", 1)[1])
    found = [x.path for x in fs.get_file_info(FileSelector(f"{root}/parts={part // step}", allow_not_found=True)) if x.path.endswith(".parquet")]
    if not found:
        return None
    own = [("part", "=", part)]
    return pa.concat_tables([pq.read_table(f, filesystem=fs, filters=own, partitioning=None) for f in found])


def _place() -> int:
    from pyspark import TaskContext

    lean_worker()

    return TaskContext.get().partitionId()


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]


class Copies:
    """What the first pass found of a partition: rows that are copies, how many rows there are and their bytes."""

    def __init__(self, folder: str, part: int):
        found = _read(folder, part)
        row, size = (found.column(c).to_numpy() if found is not None else np.zeros(0, np.int64) for c in ("row", "size"))
        self.rows = set(row[row >= 0].tolist())
        self.total = int((-1 - row[row < 0]).sum()), int(size[row < 0].sum())

    def check(self, rows: int, size: int) -> None:
        if self.total != (rows, size):
            raise RuntimeError("the input changed between two passes")


def _chunks(batches: Iterator[pa.RecordBatch], copies: str, length: int, chunk: int) -> Iterator[Chunk]:
    """The texts that may hold or give repeats, in chunks that depend on the rows alone."""
    done = Copies(copies, _place())
    row, seen, rows, ids, texts, size = 0, 0, [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for i, t in zip(part.column(0).to_pylist(), _encoded(part)):
                if i is not None and len(t) >= length and row not in done.rows:
                    if size and size + len(t) > chunk:
                        yield Chunk(rows, ids, texts, length)
                        rows, ids, texts, size = [], [], [], 0
                    rows.append(row)
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                row += 1
                seen += len(t)
    done.check(row, seen)
    if texts:
        yield Chunk(rows, ids, texts, length)


def _identities(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, row = _place(), 0
        for batch in batches:
            got = [xxhash.xxh3_128_intdigest(t) for t in _encoded(batch)]
            sizes = pa.array([len(t) for t in _encoded(batch)], pa.int64())
            k1, k2 = (np.array([g >> s & (1 << 64) - 1 for g in got], np.uint64).view(np.int64) for s in (64, 0))
            rows = np.arange(row, row + len(got))
            row += len(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), part)), pa.array(rows), batch.column(0), pa.array(k1), pa.array(k2), sizes], ["part", "row", "id", "k1", "k2", "size"])

    return texts.mapInArrow(run, "part long, row long, id long, k1 long, k2 long, size long")


def _anchors(texts: DataFrame, copies: str, length: int, buckets: int, chunk_bytes: int) -> DataFrame:
    """Each chunk's different anchors by bucket: 48 bits of key with 16 of rank, and a byte for how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _place()
        for number, chunk in enumerate(_chunks(batches, copies, length, chunk_bytes)):
            key, inverse, times = np.unique(chunk.key, return_inverse=True, return_counts=True)
            docs = chunk.docs(chunk.first)
            low_doc, high_doc = np.full(len(key), len(chunk.ids)), np.full(len(key), -1)
            np.minimum.at(low_doc, inverse, docs)
            np.maximum.at(high_doc, inverse, docs)
            often = np.ceil(np.log2(np.maximum(times, 1))).astype(np.uint8) | np.where(low_doc < high_doc, 128, 0).astype(np.uint8)
            bucket = (key >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            used, cuts = np.unique(bucket[order], return_index=True)
            low = key & np.uint64((1 << 48) - 1)
            packed = []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                mine = order[a:b]
                page, rest = np.divmod(mine, 1 << 16)
                pages = np.bincount(page, minlength=(len(key) >> 16) + 1).astype("<i4")  # entries of each run of 65,536 ranks
                packed.append(len(pages).to_bytes(4, "little") + pages.tobytes() + (low[mine] << np.uint64(16) | rest.astype(np.uint64)).tobytes() + often[mine].tobytes())
            same = lambda x: pa.array(np.full(len(used), x))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), same(part), same(number), same(len(chunk.key)), pa.array(packed, pa.binary())], ["bucket", "part", "chunk", "count", "packed"])

    return texts.mapInArrow(run, "bucket long, part long, chunk long, count long, packed binary")


def _recurring(table: pa.Table) -> pa.Table:
    """The anchors of a bucket that two documents have, by chunk."""
    lean_worker()
    key, source, place, often = [], [], [], []
    parts, chunks = table.column("part").to_numpy(), table.column("chunk").to_numpy()
    for k, blob in enumerate(table.column("packed")):
        raw = blob.as_buffer()
        pages = np.frombuffer(raw, "<i4", int.from_bytes(raw[:4].to_pybytes(), "little"), 4)
        n = int(pages.sum())
        x = np.frombuffer(raw, "<u8", n, 4 + 4 * len(pages))
        key.append(x >> np.uint64(16))
        place.append(np.repeat(np.arange(len(pages), dtype=np.int64) << 16, pages) + (x & np.uint64(0xFFFF)).astype(np.int64))
        often.append(np.frombuffer(raw, np.uint8, n, 4 + 4 * len(pages) + 8 * n))
        source.append(np.full(n, k, np.int32))
    key, source, place, often = map(np.concatenate, (key, source, place, often))
    order = np.argsort(key, kind="stable")
    ranked, often = key[order], often[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ranked))))
    several = (np.diff(np.append(starts, len(ranked))) > 1) | (np.maximum.reduceat(often, starts) >= 128)
    total = np.add.reduceat(np.int64(1) << (often & 127).astype(np.int64), starts)  # at most twice the occurrences
    order, hot = order[several[group]], (total > HOT)[group][several[group]]
    by = np.argsort(source[order], kind="stable")
    order, hot = order[by], hot[by]
    cuts = np.searchsorted(source[order], np.arange(len(parts) + 1))
    used = [k for k in range(len(parts)) if cuts[k + 1] > cuts[k]]
    return pa.table(
        {
            "part": pa.array(parts[used], pa.int64()),
            "chunk": pa.array(chunks[used], pa.int64()),
            "count": table.column("count").take(pa.array(used, pa.int64())).combine_chunks(),
            "places": pa.array([place[order[cuts[k] : cuts[k + 1]]].astype("<i4").tobytes() for k in used], pa.binary()),
            "hot": pa.array([np.packbits(hot[cuts[k] : cuts[k + 1]]).tobytes() for k in used], pa.binary()),
        }
    )


#: Neighbouring windows of a hot anchor that are dealt as one block.
BLOCK = 8
SEGMENTS = "k1 long, id long, part long, row long, at long, bytes binary, places binary"


def _segments(texts: DataFrame, copies: str, recurring: str, length: int, chunk_bytes: int) -> DataFrame:
    """For each recurring anchor its bytes; for each different block of a document's hot ones its bytes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _place()
        found = _read(recurring, part)
        numbers = found.column("chunk").to_numpy() if found is not None else np.zeros(0, np.int64)
        for number, chunk in enumerate(_chunks(batches, copies, length, chunk_bytes)):
            mine = found.take(pa.array(np.flatnonzero(numbers == number))) if found is not None else None
            if mine is None or not mine.num_rows:
                continue
            if set(mine.column("count").to_pylist()) != {len(chunk.key)}:
                raise RuntimeError("the input changed between two passes")
            at, hot = [], []
            for p, h in zip(mine.column("places").to_pylist(), mine.column("hot").to_pylist()):
                at.append(np.frombuffer(p, "<i4"))
                hot.append(np.unpackbits(np.frombuffer(h, np.uint8), count=len(at[-1])).astype(bool))
            key, inverse = np.unique(chunk.key, return_inverse=True)
            state = np.zeros(len(key), np.int8)
            state[np.concatenate(at)] = 1 + np.concatenate(hot)
            state = state[inverse]
            at = np.flatnonzero(state)
            hot = state[at] == 2
            cool, raw = at[~hot], chunk.raw.tobytes()
            for a in range(0, len(cool), 20_000):
                some = cool[a : a + 20_000]
                first, last = chunk.first[some], chunk.last[some] + length
                doc = chunk.docs(first)
                pieces = [raw[x:y] for x, y in zip(first.tolist(), last.tolist())]
                key = chunk.key[some].view(np.int64)
                yield _segment_rows(key, chunk.ids[doc], part, chunk.rows[doc], first - chunk.starts[doc], pieces, [None] * len(some))
            warm = at[hot]
            for a in range(0, len(warm), 30_000):
                yield from _blocks(chunk, warm[a : a + 30_000], part, raw)

    return texts.mapInArrow(run, SEGMENTS)


def _blocks(chunk: Chunk, warm: np.ndarray, part: int, raw: bytes) -> Iterator[pa.RecordBatch]:
    """The windows of hot anchors in blocks that lie alike around the anchor; a block that a document repeats makes one row."""
    spot, first, last = chunk.spot[warm], chunk.first[warm], chunk.last[warm]
    low, high = (spot - last) // BLOCK, (spot - first) // BLOCK
    count = high - low + 1
    which = np.repeat(np.arange(len(warm)), count)
    j = low[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(spot[which] - BLOCK * j - BLOCK + 1, first[which])
    stop = np.minimum(spot[which] - BLOCK * j, last[which]) + chunk.length
    doc = chunk.docs(start)
    inside = start - chunk.starts[doc]
    blocks: dict[tuple[int, bytes], list[int]] = {}
    for d, a, b, at in zip(doc.tolist(), start.tolist(), stop.tolist(), inside.tolist()):
        blocks.setdefault((d, raw[a:b]), []).append(at)
    keys = list(blocks)
    for a in range(0, len(keys), 20_000):
        some = keys[a : a + 20_000]
        of = np.array([d for d, _ in some], np.int64)
        pieces = [x for _, x in some]
        places = [np.sort(np.array(blocks[k], "<i4")).tobytes() for k in some]
        yield _segment_rows(np.zeros(len(some), np.int64), chunk.ids[of], part, chunk.rows[of], np.zeros(len(some), np.int64), pieces, places)


def _single_windows(blocks: DataFrame, length: int) -> DataFrame:
    """Blocks as their windows: ``window, id, part, row, at`` (from the block's start) and ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                raw = part.column(4).to_pylist()
                n = np.array([len(x) - length + 1 for x in raw], np.int64)
                take = pa.array(np.repeat(np.arange(len(n)), n))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found = pa.array([x[k : k + length] for x in raw for k in range(len(x) - length + 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([found, *(part.column(k).take(take) for k in (0, 1, 2)), pa.array(at), part.column(3).take(take)], ["window", "id", "part", "row", "at", "places"])

    return blocks.select("id", "part", "row", "places", "bytes").mapInArrow(run, "window binary, id long, part long, row long, at long, places binary")


def _runs(later: DataFrame) -> DataFrame:
    """Removed runs of rows ``part, row, places``: each place moved by ``shift``, ``size`` bytes long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, start, stop = [], [], []
            for i, (raw, shift, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                at = np.frombuffer(raw, "<i4").astype(np.int64) + shift
                cuts = np.flatnonzero(np.diff(at) > size) + 1
                of += [i] * (len(cuts) + 1)
                start += at[np.concatenate(([0], cuts))].tolist()
                stop += (at[np.append(cuts, len(at)) - 1] + size).tolist()
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["part", "row", "start", "stop"])

    return later.select("part", "row", "places", "shift", "size").mapInArrow(run, "part long, row long, start long, stop long")


def _hot_runs(hot: DataFrame, length: int) -> DataFrame:
    """Removed runs of hot blocks.

    A block that a smaller id has too goes as a whole.  Of the others each
    window is looked up: the smallest id that has a window has it in such a
    block, since else a still smaller one would have the block.
    """

    def earliest(df: DataFrame, key: str, name: str) -> DataFrame:
        found = df.groupBy(key).agg(F.min("id").alias("first"), F.max("id").alias("latest")).where("latest > first")
        return written(found.select(key, "first"), name)

    known = hot.join(earliest(hot, "bytes", "earliest-blocks"), "bytes", "left")
    whole = known.where("id > first").select("part", "row", "places", F.lit(0).cast("long").alias("shift"), F.octet_length("bytes").cast("long").alias("size"))
    single = written(_single_windows(known.where("first IS NULL OR id = first"), length), "windows")
    found = single.join(earliest(single, "window", "earliest-windows"), "window").where("id > first")
    return _runs(whole.union(found.select("part", "row", "places", F.col("at").alias("shift"), F.lit(length).cast("long").alias("size"))))


def _segment_rows(k1, ids, part, rows, at, pieces, places) -> pa.RecordBatch:
    arrays = [pa.array(k1), pa.array(ids), pa.array(np.full(len(ids), part)), pa.array(rows), pa.array(at), pa.array(pieces, pa.binary()), pa.array(places, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SEGMENTS.split(", ")])


def _holders(pieces: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of each piece starts in all pieces side by side; by place, the smallest id of an equal window."""
    size = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"\0".join(pieces), np.uint8)
    ends = np.cumsum(size + 1) - 1
    letters = raw.astype(np.uint16) + 1
    letters[ends[:-1]] = 0  # no window reaches over the end of a piece
    array = suffix_array(letters, 257, length)
    owner = np.repeat(np.arange(len(pieces)), size + 1)[: len(raw)]
    whole = np.arange(len(raw)) + length <= ends[owner]
    equal = permuted_prefixes(raw, array, length, whole)[array] >= length
    groups = np.flatnonzero(~equal)
    smallest = np.minimum.reduceat(least[owner[array]], groups)
    holder = np.empty(len(raw), np.int64)
    holder[array] = np.repeat(smallest, np.diff(np.append(groups, len(array))))
    return np.flatnonzero(whole), holder


def _shard(length: int):
    """Removed runs of a shard's documents: ``part, row, start, stop``."""

    def run(table: pa.Table) -> pa.Table:
        lean_worker()
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        coded = table.column("bytes").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        which, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        size = np.array([len(p) for p in pieces], np.int64)
        least = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        anchor = np.empty(len(pieces), np.int64)
        anchor[which] = table.column("k1").to_numpy()
        _, group, times = np.unique(anchor, return_inverse=True, return_counts=True)
        several = times[group] > 1
        # Every window of every piece, and the smallest id that holds it.
        windows = size - length + 1
        base = np.cumsum(windows) - windows
        holder = np.repeat(least, windows)
        if several.any():  # a piece that is all its anchor has is in order already
            some = np.flatnonzero(several)
            at, found = _holders([pieces[i] for i in some], least[some], length)
            into = np.repeat(base[some], windows[some]) + np.arange(windows[some].sum()) - np.repeat(np.cumsum(windows[some]) - windows[some], windows[some])
            holder[into] = found[at]
        count = size[which] - length + 1
        row = np.repeat(np.arange(len(which)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = holder[base[which][row] + offset] < ids[row]
        row, offset = row[gone], offset[gone]
        if not len(row):
            return pa.table({c: pa.array([], pa.int64()) for c in ("part", "row", "start", "stop")})
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))
        head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
        base = table.column("at").to_numpy()[row[head]]
        take = row[head]
        return pa.table({"part": table.column("part").to_numpy()[take], "row": table.column("row").to_numpy()[take], "start": base + offset[head], "stop": base + offset[tail] + length})

    return run


def _results(texts: DataFrame, copies: str, removed: str, length: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, seen = _place(), 0, 0
        done = Copies(copies, part)
        cut = _read(removed, part)
        if cut is not None:
            rows, start, stop = (cut.column(c).to_numpy() for c in ("row", "start", "stop"))
            order = np.lexsort((stop, start, rows))
            rows, start, stop = rows[order], start[order], stop[order]
        else:
            rows = start = stop = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
                valid = some.column(1).is_valid().to_pylist()
                for k, text in enumerate(_encoded(some)):
                    a, b = np.searchsorted(rows, [number, number + 1])
                    if number in done.rows:
                        runs = [(0, len(text))]
                    elif a == b:
                        runs = []
                    else:
                        reach = np.maximum.accumulate(stop[a:b])
                        new = np.concatenate(([True], start[a + 1 : b] > reach[:-1]))  # runs that touch are one
                        head = np.flatnonzero(new)
                        runs = list(zip(start[a:b][head].tolist(), np.append(reach[head[1:] - 1], reach[-1]).tolist()))
                    edges = [0, *[x for r in runs for x in r], len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if runs else text
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(len(text) - len(kept))
                    out["n_spans"].append(len(runs))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["text"].append(kept.decode("utf-8", "ignore") if with_text and valid[k] else None)
                    number += 1
                    seen += len(text)
                arrays = [some.column(0), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), *([pa.array(out["text"], pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if with_text else [])])
        done.check(number, seen)

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)


@contextlib.contextmanager
def _settings(spark):
    """While a job runs the scan's splits don't follow the number of executors, and batches of texts stay small."""
    wanted = {"spark.sql.files.minPartitionNum": str(max(1, spark.sparkContext.defaultParallelism)), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _by_part(df: DataFrame, name: str, parts: int) -> str:
    """Write what ``_read`` finds by the scan's partition; the path."""
    step = max(1, -(-parts // MOST_FOLDERS))
    path = f"{new_path(df.sparkSession, name)}-by-{step}"
    kept = df.withColumn("parts", F.floor(F.col("part") / step)).repartition("parts").sortWithinPartitions("parts", "part")
    kept.write.option("compression", "zstd").partitionBy("parts").parquet(path)
    return path


def remove_repeats(documents: DataFrame, *, length: int = 50, with_text: bool = False, stored: bool = False) -> DataFrame:
    """One row per document row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with ``with_text`` also the remaining ``text``.

    Texts are UTF-8 bytes (null: empty).  Each byte covered by a string of
    ``length`` bytes that also starts in a document with a smaller id is
    removed; strings are judged on the input.  Texts shorter than ``length``,
    null and empty ones stay as they are.  Rows that share an id never remove
    from each other; a null id neither removes nor loses anything.  An empty
    table gives no rows.  The remaining text leaves out characters that a cut
    has broken.  ``stored`` says that ``documents`` is a plain read of files;
    otherwise it is written first.  ``length`` is ``GRAM + 8`` at least.
    """
    if length < GRAM + 8:
        raise ValueError(f"length: {length}")
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts if stored else written(texts, "texts")
    with _settings(spark):
        same = written(_identities(texts), "identities")
        total, last = same.agg(F.sum("size"), F.max("part")).first()
        total, parts = total or 0, (last or 0) + 1
        known = same.where(f"id IS NOT NULL AND size >= {length}")
        # Written, as the tables of smallest ids are below, so that hot keys of the joins are split.
        repeated = written(known.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("k1", "k2", "first"), "repeated")
        of_parts = same.groupBy("part").agg((-1 - F.count(F.lit(1))).alias("row"), F.sum("size").alias("size"))
        copies = _by_part(known.join(repeated, ["k1", "k2"]).where("id > first").select("part", "row", F.lit(0).cast("long").alias("size")).union(of_parts), "copies", parts)

        chunk = min(LARGEST_CHUNK, max(CHUNK, total // MOST_CHUNKS))
        buckets = int(max(8, total // (2 * BUCKET_BYTES)))  # an anchor takes 8 bytes for 16 of text, about
        dealt = _anchors(texts, copies, length, buckets, chunk).repartition(buckets, "bucket").groupBy("bucket")
        recurring = _by_part(dealt.applyInArrow(_recurring, "part long, chunk long, count long, places binary, hot binary"), "recurring", parts)

        segments = written(_segments(texts, copies, recurring, length, chunk), "segments")
        cool, hot = segments.where("places IS NULL"), segments.where("places IS NOT NULL")
        shards = int(max(1, -(-(cool.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // SHARD_BYTES)))
        # By ranges, so that each task has one shard.
        sharded = cool.withColumn("shard", F.pmod(F.xxhash64("k1"), F.lit(shards))).repartitionByRange(shards, "shard")
        runs = sharded.groupBy("shard").applyInArrow(_shard(length), "part long, row long, start long, stop long")
        removed = _by_part(runs.union(_hot_runs(hot, length)), "removed", parts)
        results = written(_results(texts, copies, removed, length, with_text), "results")
        for table in (same, repeated, segments):
            dropped(table)
        for path in (copies, recurring, removed):
            delete(spark, path)
        return results
