"""Line dedup by pairwise alignment.

1. Every text becomes a sequence of line hashes.  From each line the shortest
   run onwards, and the shortest run backwards, that has ``min_words`` words is
   a window; most are single lines.  A line of fewer words is too common to
   tell that two documents overlap, so it counts with its neighbours only.
2. Documents meet through shared windows: each is paired with the first holder
   of every window that it has.  A pair carries the lines that its windows
   cover and where they lie on both sides, so the work follows the text that
   two documents share, however long they are and however many share it.
3. The pair's lines are aligned by patience diff, and aligned blocks of
   ``min_words`` words are deleted from the later document.  A diff keeps one
   order: windows that it leaves out, since their passage stands elsewhere or
   is repeated, are aligned singly and go too.

Each line of a run of ``min_words`` words or more lies in a window that ends
inside that run: the one onwards from the run's start or the one backwards from
the line itself.  So what goes is every line in such a run that any earlier
document has, whatever else the two share and however many documents have it.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shared import written


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit keys (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lines:
    """A text's lines: words of each, places of those with words, and these woven as hash, gap, hash, gap, ...

    Lines are compared without outer white space; a gap is the distance to the
    next line with words.  Windows are found by one half of the 128-bit line
    hashes and aligned by the other.
    """

    def __init__(self, text: str):
        import xxhash

        lines = text.encode("utf-8", "surrogatepass").split(b"\n")
        self.words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
        self.at = np.flatnonzero(self.words)
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(lines[i].strip()) for i in self.at.tolist()]), ">u8").astype(np.uint64)
        self.keys = hashes[::2].copy()
        self.woven = np.zeros(len(hashes), np.uint64)
        self.woven[::2] = hashes[1::2]
        self.woven[1:-1:2] = np.diff(self.at)
        self.raw = self.woven.tobytes()

    def core(self, i: int, j: int) -> bytes:
        """The lines with words from number ``i`` to ``j``, and the gaps between them."""
        return self.raw[16 * i : 16 * j + 8]


def windows(lines: Lines, min_words: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Text, key, first line, end and core of the shortest runs of ``min_words`` words from each line onwards and backwards.

    Equal runs have equal keys.  ``ends``: where each of several texts, joined
    by line feeds, ends; no run reaches into another.  Work is linear.
    """
    import xxhash

    at = lines.at
    ends = np.array([len(lines.words)]) if ends is None else ends
    starts = np.concatenate([[0], ends[:-1]])
    of = np.searchsorted(ends, at, "right")
    low, high = np.searchsorted(of, of, "left"), np.searchsorted(of, of, "right")  # the text's lines with words
    place = np.arange(len(at))
    total = np.concatenate([[0], np.cumsum(lines.words[at])])
    # Each line's last, by its shortest run onwards, and the first of the shortest run backwards.
    last = np.searchsorted(total, total[:-1] + min_words) - 1
    first = np.searchsorted(total, total[1:] - min_words, "right") - 1
    onwards = np.flatnonzero(last < high)
    backwards = np.flatnonzero(first >= low)
    woven = lines.woven.copy()
    woven[::2] = lines.keys
    raw = woven.tobytes()

    def keys(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = lines.keys[i]
        several = np.flatnonzero(i < j)
        cuts = zip((16 * i[several]).tolist(), (16 * j[several] + 8).tolist())
        out[several] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in cuts), np.uint64, len(several))
        return out

    one, two = keys(onwards, last[onwards]), keys(first[backwards], backwards)
    own = last[first[backwards]] != backwards  # not a run onwards too
    found = [(one, onwards, last[onwards], at[onwards], at[last[onwards]] + 1), (two[own], first[backwards][own], backwards[own], at[first[backwards]][own], at[backwards][own] + 1)]
    # Lines without words before a run onwards and after one backwards: its key and their number.
    step = np.uint64(0x9E3779B97F4A7C15)
    above = np.where(place == low, starts[of] - 1, np.concatenate([[0], at])[:-1])
    below = np.where(place == high - 1, ends[of], np.append(at, 0)[1:])
    before, after = (at - above - 1)[onwards], (below - at - 1)[backwards]
    n = np.arange(before.sum()) - np.repeat(np.cumsum(before) - before, before) + 1
    i = np.repeat(onwards, before)
    found.append((_mixed(np.repeat(one, before) + n.astype(np.uint64) * step), i, last[i], at[i] - n, at[last[i]] + 1))
    n = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after) + 1
    j = np.repeat(backwards, after)
    found.append((_mixed(np.repeat(two, after) - n.astype(np.uint64) * step), first[j], j, at[first[j]], at[j] + 1 + n))
    key, i, j, start, stop = map(np.concatenate, zip(*found))
    text = of[i]
    cores = [lines.raw[a:b] for a, b in zip((16 * i).tolist(), (16 * j + 8).tolist())]
    return text, key, start - starts[text], stop - starts[text], cores


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second rises too (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect.bisect_left(tops, j)
        if pile:
            back[k] = at[pile - 1]
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(seq: list, lo: int, hi: int) -> dict:
    """Places of the lines that the range has once."""
    seen: dict = {}
    for i in range(lo, hi):
        x = seq[i]
        seen[x] = -1 if x in seen else i
    return seen


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two sequences, rising in both.

    A range gives its common head and tail, then the longest rising run of
    lines that both have once; what lies between these is treated likewise.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        left, right = _once(a, a0, a1), _once(b, b0, b1)
        common = sorted((i, right[x]) for x, i in left.items() if i >= 0 and x and right.get(x, -1) >= 0)
        anchors = _longest_rising(common)
        if not anchors:
            continue
        ends = [*anchors, (a1, b1)]
        p, q = a0, b0
        for i, j in ends:
            if p < i and q < j:
                todo.append((p, i, q, j))
            if i < a1:
                out.append((i, j))
            p, q = i + 1, j + 1
    return sorted(out)


def aligned(later: Lines, shared: list[tuple[int, int, int, bytes]], min_words: int) -> list[tuple[int, int]]:
    """Line ranges of the later document that a pair deletes, from its shared windows (start in the earlier one; start, stop; core)."""
    out, lines, follows, mine, verified = [], {}, {}, set(), []
    for start_e, start, stop, core in shared:
        i = bisect.bisect_left(later.at, start)
        c = np.frombuffer(core, np.uint64)
        place = start_e + int(later.at[i]) - start
        lines[place] = int(c[0])
        for h, gap in zip(c[2::2].tolist(), c[1::2].tolist()):
            follows[place] = gap
            place += gap
            lines[place] = h
        j = i + len(c) // 2
        mine.update(range(i, j + 1))
        if later.core(i, j) == core:
            verified.append((start, stop))
    theirs, own = sorted(lines), sorted(mine)
    at, words = later.at[own].tolist(), later.words[later.at[own]].tolist()
    pairs = patience([lines[p] for p in theirs], later.woven[::2][own].tolist())
    k = 0
    while k < len(pairs):
        a, b = pairs[k]
        n = 1
        while k + n < len(pairs) and pairs[k + n] == (a + n, b + n) and own[b + n] == own[b] + n:
            gap = at[b + n] - at[b + n - 1]
            if follows.get(theirs[a + n - 1]) != gap or theirs[a + n] - theirs[a + n - 1] != gap:
                break
            n += 1
        if sum(words[b : b + n]) >= min_words:
            out.append((at[b], at[b + n - 1] + 1))
        k += n
    return out + verified


#: Texts that are read together, and their bytes; a longer one is read alone.
TEXTS, BYTES = 256, 4 << 20
HELD = "h long, id long, k long, start int, stop int, core binary"


def _windows(documents: DataFrame, min_words: int) -> DataFrame:
    """A row for each window of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = reach[at - 1] if at else 0
                n = max(1, min(TEXTS, int(np.searchsorted(reach, before + BYTES, "right")) - at))
                part = batch.slice(at, n)
                at += n
                texts = part.column(2).to_pylist()
                ends = np.cumsum([t.count("\n") + 1 for t in texts])
                text, h, start, stop, cores = windows(Lines("\n".join(texts)), min_words, ends)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(cores, pa.binary())], [c.split()[0] for c in HELD.split(", ")])

    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("k"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    return texts.mapInArrow(run, HELD)


def shared_windows(documents: DataFrame, *, min_words: int = 10) -> DataFrame:
    """``id, k, shared``: for each text (``k``: its xxhash64) the windows that an earlier document has: its id and start there, start, stop and core."""
    held = written(_windows(documents, min_words), "windows")
    # Written, so that the join below is one whose hot windows are split or, where recurring windows are few, a broadcast one.
    holders = held.groupBy("h").agg(F.min(F.struct("id", "start", "core")).alias("e"), F.max("id").alias("latest")).where("latest > e.id")
    firsts = written(holders.select("h", F.col("e.id").alias("first"), F.col("e.start").alias("start_e"), F.col("e.core").alias("core")), "firsts")
    met = held.drop("core").join(firsts, "h").where("id > first")
    return met.groupBy("id", "k").agg(F.collect_set(F.struct("first", "start_e", "start", "stop", "core")).alias("shared"))


RESULT = "n_lines long, n_words long, n_removed_lines long, n_removed_words long, n_blocks long, kept_sha256 string"


def _pairs(column: pa.ListArray) -> Iterator[list[list[tuple[int, int, int, bytes]]]]:
    """For each row the shared windows of each of its pairs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    first, *places = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    cores = flat.field(4)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        order = a + np.argsort(first[a:b], kind="stable")
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        yield [list(zip(*(p[some].tolist() for p in places), cores.take(pa.array(some)).to_pylist())) for some in np.split(order, cuts)] if b > a else []


def dedup_lines(documents: DataFrame, *, min_words: int = 10) -> DataFrame:
    """The documents with ``text`` reduced, and what was removed in columns of ``RESULT`` (input columns of these names give way).

    A null or empty text, and a row with a null id, stays as it is.  Rows that
    repeat an id are aligned with smaller ids only.  A text of ``min_words``
    words or more that an earlier document has as a whole is left empty.  Line feeds between kept lines stay.
    An empty table gives no rows.
    """
    extra = {x.split()[0] for x in RESULT.split(", ")}
    kept = [c for c in documents.columns if c not in extra]
    shared = shared_windows(documents, min_words=min_words).withColumnsRenamed({"id": "_id", "k": "_k", "shared": "_shared"})
    joined = documents.select(*kept).join(shared, (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_k")), "left").drop("_id", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for text, pairs in zip(part.column("text").to_pylist(), _pairs(part.column("_shared"))):
                    lines = (text or "").split("\n")
                    if pairs:
                        later = Lines(text)
                        sizes = later.words.tolist()
                    else:
                        sizes = [len(x.encode("utf-8", "surrogatepass").split()) for x in lines]
                    gone = bytearray(len(lines))
                    for pair in pairs:
                        for start, stop in aligned(later, pair, min_words):
                            gone[start:stop] = b"\1" * (stop - start)
                    cut = sum(gone)
                    new = "\n".join(x for x, g in zip(lines, gone) if not g) if cut else text
                    blocks = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)) if cut else 0
                    digest = hashlib.sha256((new or "").encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((new, len(lines) if text else 0, sum(sizes), cut, sum(s for s, g in zip(sizes, gone) if g), blocks, digest))
                found = list(zip(*out))
                arrays = [pa.array(found[0], pa.string()) if c == "text" else part.column(c) for c in kept]
                arrays += [pa.array(x, pa.int64()) for x in found[1:6]] + [pa.array(found[6], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *(x.split()[0] for x in RESULT.split(", "))])

    schema = T.StructType([documents.schema[c] for c in kept] + list(T.StructType.fromDDL(RESULT)))
    return joined.mapInArrow(run, schema)


def without_common_lines(documents: DataFrame, **limits) -> DataFrame:
    """The documents' columns; texts without the runs that an earlier document has, documents left without words dropped where blocks were removed."""
    own = {c: f"_own_{i}" for i, c in enumerate(documents.columns) if c not in ("doc_id", "text")}
    out = dedup_lines(documents.withColumnsRenamed(own), **limits).where("n_removed_lines = 0 OR n_removed_words < n_words")
    return out.select(*[out[own.get(c, c)].alias(c) for c in documents.columns])
