"""Connected components by alternating large-star and small-star rounds, over DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, written

#: Edges up to which one task labels them all (16 bytes each, several times); more go through rounds.
AT_ONCE = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _moved(edges: DataFrame, keep: str, ends: str) -> tuple[DataFrame, DataFrame]:
    """From each node's edges (u, v) that ``keep`` names, edges of v to the least node near u; and the least nodes, written: a
    join with a written table can deal out a hub's rows to several tasks, one with an aggregate can't."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.expr(ends).alias("m")), "least")
    return edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _round(edges: DataFrame) -> DataFrame:
    """A large star, then a small star."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved, near = _moved(both, "v > u AND v <> m", "least(u, m)")
    large = written(moved.distinct(), "edges")
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved, least = _moved(down, "v <> m", "m")
    out = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    for old in (near, large, least):
        discard(old)
    return out


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges in ascending order, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    labels = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[labels]


def _at_once(edges: DataFrame) -> DataFrame:
    """Labels of a bounded number of edges, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if held:
            found = least_labels(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in found], ["node", "component"])

    return written(edges.coalesce(1).mapInArrow(run, "node long, component long"), "labels")


def connected_components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Edges (u, v) of longs to (node, component), where component is the smallest node that can be reached.

    Nodes without an edge to another node are not in the result. Up to ``at_once`` edges are labelled by one task, as rounds
    of jobs cost the driver and the cluster more than that few edges do; beyond, the rounds grow with the logarithm
    of the longest path; each is written to the shared folder, which cuts the lineage. The driver
    gets two numbers a round.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = _state(edges)
    if state[0] <= at_once:
        return _at_once(edges)
    while state[0]:
        old, edges = edges, _round(edges)
        before, state = state, _state(edges)
        discard(old)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
