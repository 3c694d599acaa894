"""Connected components of an edge table, by contraction.

Every round each node moves to the smallest of its neighbours and itself under
an order that changes with the round, and the edges are renamed accordingly.
An edge table never grows, hubs meet in partial minima, and every round is
written to the shared folder, so that lost executors cost one round at most.
Once no more than ``FEW`` edges are left, one task of that bounded size ties
them together; the nodes never go through it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shared import dropped, written


#: Edges that one task may take: 16 MB.
FEW = 1 << 20


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``v, to``: each node of the edges and the smallest that it reaches."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if not a:
        return
    ids, at = np.unique(np.concatenate(a + b), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(ids))
    while len(a):
        least = np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["v", "to"])


def components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """``id, component`` for every id of ``edges`` (columns ``a, b``: long).

    ``component`` is the smallest id that can be reached.  Loops and repeated
    edges do no harm, edges with a null are left out, no edges give no rows.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    live = written(ends.distinct(), "edges")
    labels = None
    rng = random.Random(seed)
    while live.count() > FEW:
        mask = F.lit(rng.getrandbits(62)).cast("long")
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("x"))
        moved = written(nearest.select(F.col("a").alias("v"), F.least("x", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")), "moves")
        first = live.join(moved, F.col("a") == F.col("v")).select(F.col("to").alias("a"), "b")
        both_ends = first.join(moved, F.col("b") == F.col("v")).select("a", F.col("to").alias("b"))
        new_live = written(both_ends.where("a <> b").distinct(), "edges")
        if labels is None:
            new_labels = written(moved.select(F.col("v").alias("id"), F.col("to").alias("c")), "labels")
        else:
            new_labels = written(labels.join(moved, F.col("c") == F.col("v"), "left").select("id", F.coalesce("to", "c").alias("c")), "labels")
            dropped(labels)
        dropped(live)
        dropped(moved)
        live, labels = new_live, new_labels
    tied = live.coalesce(1).mapInArrow(_tied, "v long, to long")
    if labels is None:
        return tied.select(F.col("v").alias("id"), F.col("to").alias("component"))
    ends = labels.join(tied, F.col("c") == F.col("v"), "left").select("id", F.coalesce("to", "c").alias("c"))
    # The contraction moves by other orders, so a class's name need not be its smallest id.
    smallest = ends.groupBy("c").agg(F.min("id").alias("component"))
    return ends.join(smallest, "c").select("id", "component")
