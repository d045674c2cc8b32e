"""Connected components of an edge table.

Each partition first keeps a spanning forest of its edges (union-find over arrays). Then every node
takes the least label among itself and its neighbours, and labels are replaced by their labels'
labels, until nothing changes; each round is written to the shared folder. Sums over a hub's edges are
partial aggregates, so a node with any number of neighbours is no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import FEW, release, written

#: Edges that one forest takes in.
EDGES = 1 << 20


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1))
        size += b.num_rows
        if size >= EDGES:
            yield _forest(np.concatenate(held))
            held, size = [], 0
    if size:
        yield _forest(np.concatenate(held))


def _forest(edges: np.ndarray) -> pa.RecordBatch:
    nodes, index = np.unique(edges, return_inverse=True)
    index = index.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[index[:, 0]], label[index[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[index[:, 0]], least)
        np.minimum.at(new, label[index[:, 1]], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label, was) for each node of the edges (a, b): label is the least node of its component. A written table."""
    tree = written(edges.select("a", "b").mapInArrow(forest, "a long, b long"), "forest")
    both = written(tree.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(tree.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    held = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "labels")
    release(tree)
    # a row a node: a table of few is sent whole, so that a round shuffles once
    near_by = F.broadcast if held.count() <= FEW else lambda df: df
    while True:
        labels = held.select("node", "label")
        near = both.join(near_by(labels.select(F.col("node").alias("other"), "label")), "other").groupBy("node").agg(F.min("label").alias("near"))
        hooked = near.join(near_by(labels), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(hooked.join(near_by(up), "label").select("node", "was", F.least("label", "up").alias("label")), "labels")
        release(held)
        held = new
        if new.where("label != was").isEmpty():
            release(both)
            return new
