"""Near-duplicate documents by SetSketch bands, likelihood and full sets.

1. One pass over the texts: the set of shingles, its size, a 128-bit identity
   and its registers.  Equal sets meet in partial aggregates and stay one node.
2. Documents with an equal band of registers are candidates.  A band's bucket
   is tied together by edges to its smallest member, never by all pairs; the
   components of these edges are the clusters in which links can lie.
3. A cluster that fits into memory is examined by one task.  A larger one is
   dealt in the way that sends fewer documents.  By blocks: it is cut by set
   size (a link joins neighbouring classes of size only) and by a hash of the
   id, and each pair of blocks that can hold a link is a task; so a group of
   near copies, which share most buckets, is compared once.  By buckets: each
   is a task, cut into pairs of blocks where it is large; so a chain of weak
   candidates, whose buckets are small, costs a few tasks a document however
   long it is.  Either way tasks are bounded, no bucket is capped and no pair
   that shares one is lost.
4. A task estimates similarity by likelihood from the registers, verifies
   pairs on the full sets where the estimate doesn't rule a link out, and
   returns a spanning forest of the links.  Components of these are classes.

With 42 bands of 6 registers a pair of similarity 0.85 shares no bucket with
probability 2e-9, one of 0.8 with 3e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import setsketch
from quernstone.llm.components import components
from quernstone.llm.shared import dropped, written
from quernstone.llm.shingles import ODD, Words, mix, shingle_set

#: Bounds of what a task examines together: documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 768, 1_500_000
#: Bytes of candidates with their tasks that may be broadcast to pick them out of the documents; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def signatures(documents: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n, k1, k2, sketch`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            n, k1, k2, sk = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), memo, size)
                n.append(len(s))
                k1.append(s.sum(dtype=np.uint64))
                k2.append(np.bitwise_xor.reduce(mix(s + ODD[4])))
                sk.append(setsketch.sketch(s).tobytes() if len(s) else b"")
            keys = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *keys, pa.array(sk, pa.binary())], ["doc_id", "n", "k1", "k2", "sketch"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                registers = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16)
                keys = setsketch.band_keys(registers).view(np.int64).ravel()
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), setsketch.BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "id"])

    return nodes.select("id", "sketch").mapInArrow(run, "key long, id long")


def _same_bucket(nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` from each member of a bucket to its smallest."""
    bands = _bands(nodes)
    least = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("a")).where("m > 1").select("key", "a")
    return bands.join(least, "key").where("id <> a").select("a", F.col("id").alias("b"))


def _tasks(clusters: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``id, tasks``: the tasks that each candidate belongs to, with its block there."""
    width = -math.log(percent / 100) * 1.0001
    placed = clusters.join(nodes.select("id", "n"), "id").withColumn("cls", F.floor(F.log("n") / width).cast("int"))
    placed = written(placed, "clusters")
    by_class = placed.groupBy("component", "cls").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(F.col("d") * 2.0 / BLOCK_DOCS, F.col("s") * 2.0 / BLOCK_SHINGLES)).cast("int")
    large = (
        by_class.groupBy("component")
        .agg(F.sum("d").alias("d"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("cls", blocks.alias("nb")))).alias("nb"))
        .where((F.col("d") > BLOCK_DOCS) | (F.col("s") > BLOCK_SHINGLES))
        .select("component", "nb")
    )
    large = written(large, "large-clusters")
    joined = placed.join(large, "component", "left").withColumn("own", F.expr("pmod(xxhash64(id), nb[cls])"))
    name = lambda *x: F.concat_ws(".", F.col("component"), *x)
    none = F.array().cast("array<string>")

    def against(other: int):
        count = F.expr(f"nb[cls + {other}]")
        mine, its = (F.col("cls"), F.col("own")), lambda j: (F.col("cls") + other, j)
        pair = {0: lambda j: name(F.col("cls"), F.least("own", j), F.col("cls"), F.greatest("own", j)), 1: lambda j: name(*mine, *its(j)), -1: lambda j: name(*its(j), *mine)}[other]
        return F.when(count.isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), pair)).otherwise(none)

    tasks = F.when(F.col("nb").isNull(), F.array(F.col("component").cast("string"))).otherwise(F.concat(against(-1), against(0), against(1)))
    block = F.when(F.col("nb").isNull(), F.lit("")).otherwise(F.concat_ws(".", "cls", "own"))
    by_block = joined.select("id", tasks.alias("tasks"), block.alias("block"), "component")
    if large.isEmpty():
        return by_block.drop("component")

    # What the large clusters would send by buckets, and what by blocks.
    members = _bands(nodes.join(placed.join(large.select("component"), "component").select("id", "component"), "id")).join(placed.select("id", "n", "component"), "id")
    ways = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("m") * 2.0 / BLOCK_DOCS, F.col("s") * 2.0 / BLOCK_SHINGLES)))
    whole = (F.col("m") <= BLOCK_DOCS) & (F.col("s") <= BLOCK_SHINGLES)
    buckets = members.groupBy("component", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("m > 1")
    buckets = written(buckets.select("component", "key", "m", F.when(whole, 1).otherwise(ways).cast("long").alias("ways")), "buckets")
    sent = buckets.groupBy("component").agg(F.sum(F.col("m") * F.col("ways")).alias("by_buckets"))
    around = F.expr("coalesce(nb[cls - 1], 0) + coalesce(nb[cls], 0) + coalesce(nb[cls + 1], 0)")
    sent = sent.join(by_class.join(large, "component").groupBy("component").agg(F.sum(F.col("d") * around).alias("by_blocks")), "component")
    loose = written(sent.where("by_buckets < by_blocks").select("component"), "loose-clusters")
    mine = F.expr("pmod(xxhash64(id), ways)")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1), lambda j: F.concat_ws(".", F.lit("b"), "component", "key", F.least(mine, j), F.greatest(mine, j)))
    by_bucket = members.join(buckets, ["component", "key"]).join(loose, "component").groupBy("id").agg(F.flatten(F.collect_list(pairs)).alias("tasks"))
    return by_block.join(loose, "component", "left_anti").select("id", "tasks", "block").union(by_bucket.select("id", "tasks", F.lit("").alias("block")))


def _examine(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        blocks = np.unique(np.array(table.column("block").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        order = np.argsort(ids, kind="stable")
        ids, blocks = ids[order], blocks[order]
        raw, sk = table.column("hashes").to_pylist(), table.column("sketch").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order]
        sk = np.frombuffer(b"".join(sk[i] for i in order), np.uint16).reshape(-1, setsketch.REGISTERS)
        n = np.array([len(s) for s in sets])
        two = blocks.max(initial=0) > 0
        margin = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / setsketch.REGISTERS)
        found = []
        for i in range(len(ids) - 1):
            ok = 100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :])
            ok &= ids[i + 1 :] != ids[i]
            if two:
                ok &= blocks[i + 1 :] != blocks[i]
            js = np.flatnonzero(ok) + i + 1
            if not len(js):
                continue
            other = sk[js]
            above = (sk[i] > other).sum(1)
            below = (sk[i] < other).sum(1)
            near = np.flatnonzero(setsketch.REGISTERS - above - below >= (margin - 0.05) * setsketch.REGISTERS)
            if len(near):
                found.append((np.full(len(near), i), js[near], above[near], below[near]))
        a, b = [], []
        if found:
            i, j, above, below = map(np.concatenate, zip(*found))
            guess = setsketch.similarity(n[i], n[j], above, below)
            root = list(range(len(ids)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for k in np.argsort(-guess, kind="stable"):
                if guess[k] < margin:
                    break
                x, y = top(int(i[k])), top(int(j[k]))
                if x == y:
                    continue
                small, large = sorted((sets[i[k]], sets[j[k]]), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                if 100 * common >= percent * (len(small) + len(large) - common):
                    root[max(x, y)] = min(x, y)
                    a.append(ids[i[k]])
                    b.append(ids[j[k]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(documents: DataFrame, picked: DataFrame, percent: int, size: int) -> DataFrame:
    """Verified links ``a, b`` among the candidates with their tasks, enough to tie all linked nodes together."""
    size_of = F.lit(64) + F.octet_length("block") + F.octet_length(F.concat_ws(" ", "tasks")) + 16 * F.size("tasks")
    few = (picked.agg(F.sum(size_of)).first()[0] or 0) <= BROADCAST_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, memo, size) for t in part.column("text").to_pylist()]
                out = [part.column("id"), part.column("tasks"), part.column("block"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([setsketch.sketch(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["id", "tasks", "block", "hashes", "sketch"])

    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    candidates = texts.join(F.broadcast(picked) if few else picked, "id").select("id", "text", "tasks", "block")
    loaded = candidates.mapInArrow(run, "id long, tasks array<string>, block string, hashes binary, sketch binary")
    dealt = loaded.select("id", "block", "hashes", "sketch", F.explode("tasks").alias("task"))
    return dealt.groupBy("task").applyInArrow(_examine(percent), "a long, b long")


def near_duplicates(documents: DataFrame, *, percent: int = 80, size: int = 5) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where ``100 * |intersection| >= percent * |union|``;
    ``component_id`` is the smallest doc_id of the linked group, ``kept`` says
    that it is the row's own.  Null, empty and wordless texts have the empty
    set and are linked with nothing.  A row with a null id stays alone
    (``component_id`` null, kept).  Rows that repeat an id are one node.
    """
    marks = written(signatures(documents, size), "signatures")
    sets = marks.where("n > 0 AND doc_id IS NOT NULL")
    nodes = written(sets.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")), "nodes")
    # An id with several different texts ties their sets together.
    clusters = components(_same_bucket(nodes))
    picked = written(_tasks(clusters, nodes, percent), "tasks")
    links = _links(documents, picked, percent, size)
    tied = sets.select("doc_id", "n", "k1", "k2").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id")
    repeated = sets.join(tied, "doc_id").join(nodes.select("n", "k1", "k2", "id"), ["n", "k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    classes = written(components(links.union(repeated)), "classes")
    dropped(picked)
    named = nodes.select("n", "k1", "k2", "id").join(classes, "id", "left").select("n", "k1", "k2", F.coalesce("component", "id").alias("found"))
    out = marks.drop("sketch").join(named, ["n", "k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, *, percent: int = 80, size: int = 5) -> DataFrame:
    """One document of each group of near copies, all columns kept.

    Rows that repeat an id are one document and stay or go together.
    """
    verdicts = near_duplicates(documents, percent=percent, size=size)
    gone = verdicts.where("NOT kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)
