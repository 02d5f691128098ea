"""Connected components by alternating large-star and small-star steps; no task sees more than rows of its own, and each round is
written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import record, stored


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars: every node with the smallest one that the batch's edges lead to."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = np.minimum(new, new[new])
            new = new[new]
            if (new == root).all():
                break
            root = new
        off = np.flatnonzero(root != np.arange(len(nodes)))
        yield record(u=nodes[off], v=nodes[root[off]])


def components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b: long) but the roots themselves; the root is the component's smallest node.

    Edges may repeat and run either way; loops and edges with a null are left out. Without edges the result is empty.
    """
    state = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # Edges that meet in a batch are made stars there, which leaves the rounds little to do.
    now = store(now.mapInArrow(shortened, "u long, v long").distinct(), "stars")
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = store(small.distinct(), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
