"""Connected components of a table of edges.

Each task first replaces its edges by those of a spanning forest. What is left is then joined by
alternating large and small stars, until it is few enough for one task, or until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import drop_saved, lean, saved, ship

#: Edges that a task holds at a time, and that one task may finish: 16 MB.
IN_A_TASK = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node but the least of its component to that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    low = root < np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def forests(in_a_task: int):
    """Of a task's edges, forests of as many as in_a_task at a time."""

    def run(batches):
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if len(u) + len(x) > in_a_task:
                u, v = forest(u, v)
                if 2 * len(u) > in_a_task:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    u = v = np.zeros(0, np.int64)
            u, v = np.concatenate([u, x]), np.concatenate([v, y])
        u, v = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def stars(edges: DataFrame) -> DataFrame:
    """A round on distinct edges u > v: each larger neighbour of a node goes to the node's least
    neighbour, and then each smaller one. Minima are pre-aggregated before each shuffle, and a hub's edges
    meet its minimum in a join that can be split, so no task needs all edges of a hub."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()


def components(edges: DataFrame, in_a_task: int = IN_A_TASK) -> DataFrame:
    """node, root for each node of edges (u, v): root is the smallest node of its component.

    u and v are non-null longs; loops, repeated and reversed edges do no harm; no edges give an
    empty table. Each round writes its edges to the shared folder, so a lost executor costs a round at most.
    The number of rounds grows with the logarithm of the size. in_a_task decides who does the
    work, not what comes out.
    """
    ship(edges.sparkSession)
    own = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = saved(own.mapInArrow(lean(forests(in_a_task or IN_A_TASK)), "u long, v long"), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= in_a_task:
            after = saved(now.coalesce(1).mapInArrow(lean(forests(in_a_task + 1)), "u long, v long"), "edges")
        elif state == before:
            break
        else:
            after = saved(stars(now), "edges")
        drop_saved(now)
        now = after
        if state[0] <= in_a_task:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
