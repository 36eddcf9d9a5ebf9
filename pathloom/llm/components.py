"""Connected components: of an edge table by DataFrame joins, of a few edges in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the links a-b connect: one fewer than nodes in each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


#: Edges up to which one task joins them all (two numbers each); beyond, rounds of joins do.
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges``; component is its smallest reachable node.

    Few edges, by a checked count, are joined in one task. Otherwise each round takes
    the smallest label among the neighbours and then the label of that label, so that
    stars settle in two rounds and chains in about as many as the logarithm of their
    length. Minima are combined before the shuffle, so a node with very many edges is no
    hot key there. Every round is a written table.
    """
    pairs = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "components-pairs")
    if pairs.count() <= FEW_EDGES:
        labels = materialize(pairs.coalesce(1).mapInArrow(_in_one_task, "node long, component long"), "components")
        release(pairs)
        return labels
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), "components-edges")
    release(pairs)
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.lit(True).alias("changed")),
        "components",
    )
    while labels.filter("changed").limit(1).count():
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        lowest = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("lowest"))
        near = labels.select("node", "component").join(lowest, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "lowest").alias("component")
        )
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        moved = near.join(target, "component").select(
            "node", F.least("component", "onward").alias("component"), (F.least("component", "onward") < F.col("old")).alias("changed")
        )
        new = materialize(moved, "components")
        release(labels)
        labels = new
    release(both)
    return labels.select("node", "component")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of at most FEW_EDGES edges."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if ends:
        a, b = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        node, root = forest(a, b)
        roots = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([root, roots]))], names=["node", "component"])
