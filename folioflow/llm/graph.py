"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.shared import attach, materialise

EDGES = "u BIGINT, v BIGINT"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not its component's smallest one, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        # smallest label among neighbours, then labels of labels
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        u, v = forest(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` that is not its component's smallest one.

    Edges lead from the larger node to the smaller one. In a round the edges of a node meet by
    their larger end, every task reduces its part to trees of depth one, and nodes then follow
    their root's own edge: a join on the root, in which a root with very many nodes is split into
    pieces, as many as its number of nodes asks for. Rounds end when nothing changes;
    their number grows with the logarithm of a component's size. A round is a written table, so
    a lost executor costs one round at most.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before = None
    while True:
        trees = materialise(now.repartition(F.col("u")).mapInArrow(_local, EDGES), "trees")
        least = trees.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("root"))
        ends = trees.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        # one row per root, with the number of its nodes: a root with very many of them is dealt to many tasks
        lookup = materialise(ends.join(least, "v", "left"), "roots")
        jumped = attach(trees, lookup, "v", "n").select("u", F.coalesce("root", "v").alias("v"))
        # a root that has several edges must not lose the others: its own rows carry them
        now = materialise(jumped, "edges")
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
