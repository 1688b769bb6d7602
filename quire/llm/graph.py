"""Connected components of an edge table.

Each partition first contracts its own edges. What is left is finished in one
task if it is small (its size is counted first), else by alternating
large-star and small-star steps, in which no node's edges meet in one task
but in joins that can be split. Both ways give the same labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_table

#: Contracted edges (16 bytes each) up to which one task finishes the work.
FINISH = 1_000_000


def labels(a, b):
    """(nodes, least node of each one's component) of edges given as two arrays: roots hook onto lesser roots, then paths are halved."""
    import numpy as np

    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        x, y = x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]


def _contracted(batches):
    """Stars (a, b) around the least node of each component of a partition's edges."""
    import numpy as np
    import pyarrow as pa

    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    a = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int64)
    nodes, least = labels(a, b)
    some = nodes != least
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(least[some], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of an edge (a, b) of two different nodes, the least node itself included. No edges: no rows."""
    edges = shared_table(edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "a long, b long"), label)
    if edges.count() <= FINISH:
        parts, edges = edges, shared_table(edges.coalesce(1).mapInArrow(_contracted, "a long, b long"), label)
        discard(parts)
    else:
        while True:
            # in a forest of stars no node has two parents, and none is both a parent and a child
            ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
            if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
                break
            before, edges = edges, shared_table(_star(_star(edges, True), False).distinct(), label)
            discard(before)
    whole = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return whole.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
